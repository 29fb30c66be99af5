"""Paperloom: a PySpark engine for corpora of paginated documents and training text."""
