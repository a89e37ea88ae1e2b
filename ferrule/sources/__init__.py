"""Sources with declared schemas, and sinks."""
