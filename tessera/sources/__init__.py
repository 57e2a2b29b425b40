"""Readers, sinks and checks of list files."""
