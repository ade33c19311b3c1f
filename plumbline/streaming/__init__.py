"""Incremental loads fed by a file stream."""
