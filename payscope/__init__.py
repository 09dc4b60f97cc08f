"""Transaction-monitoring analytics on PySpark DataFrames."""
