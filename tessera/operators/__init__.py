"""Relational operators of the linkage pipeline."""
