"""Readers, column mapping and sinks."""
