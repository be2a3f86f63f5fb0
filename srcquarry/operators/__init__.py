"""Relational operators composed from DataFrame expressions."""
