"""Queries over the given tables and the index build and search plans."""
