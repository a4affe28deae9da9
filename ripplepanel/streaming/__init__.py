"""Incremental cleaning of newly arrived files."""
