"""Continuous forms of the log metrics and of incremental indexing."""
