"""Timed tokens, intervals and text as PySpark DataFrames."""
