"""Incremental forms of the row-local operators."""
