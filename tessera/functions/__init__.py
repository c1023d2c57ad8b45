"""Scalar and JSON functions with SQLite semantics, as Column expressions."""
