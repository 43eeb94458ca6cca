"""Query catalogue: each module has QUERIES (name -> callable) and SQL (name -> DuckDB text)."""
