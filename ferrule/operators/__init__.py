"""Operators: functions from DataFrames to DataFrames and Columns to Columns, free of any table or session of their own."""
