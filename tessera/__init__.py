"""Tessera: a strictly typed, SQLite-dialect analytics and full-text engine on PySpark."""
