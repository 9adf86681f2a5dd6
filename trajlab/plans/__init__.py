"""The registered queries, each with its DuckDB equivalent."""
