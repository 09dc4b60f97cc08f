"""DuckDB statements that answer the registered queries independently of the Spark code."""
