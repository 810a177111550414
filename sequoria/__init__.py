"""Sequence analytics on PySpark: every operator maps DataFrames to DataFrames."""
