"""Scalar functions on text and pairs of texts."""
