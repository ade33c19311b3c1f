"""Operators for building training corpora: filtering, deduplication, extraction, packing."""
