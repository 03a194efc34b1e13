"""Incremental forms of the batch layers."""
