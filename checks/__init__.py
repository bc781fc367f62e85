"""Independent SQL for every registered query (DuckDB dialect)."""
