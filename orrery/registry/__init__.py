"""Registered queries of the media operators, by subject, each with its DuckDB equivalent."""
