"""Equivalent DuckDB statements for the registered queries."""
