"""ferrule: a PySpark-native engine for technical-document corpora and engineering study data."""
