"""Incremental lookups against a static index."""
