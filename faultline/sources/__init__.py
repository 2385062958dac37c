"""Data sources: landed tables, landed files (JSON, CSV, XML) and analog views."""
