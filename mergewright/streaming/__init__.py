"""Streams of new records."""
