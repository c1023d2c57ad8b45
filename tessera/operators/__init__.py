"""Relational, full-text and write operators."""
