"""Vector-search analytics on PySpark DataFrames."""
