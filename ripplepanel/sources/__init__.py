"""Readers and writers: raw feeds, zone dimensions, panels and result tables."""
