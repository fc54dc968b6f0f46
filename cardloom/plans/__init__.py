"""Query modules. Each has QUERIES (name -> callable(spark, folder)) and SQL (name -> DuckDB text)."""
