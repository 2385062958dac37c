"""Registered queries and their DuckDB oracle twins."""
