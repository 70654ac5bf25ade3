"""Relational operators over rating data."""
