"""Operators for building training corpora: packing, tokenizing, deduplication, scoring and extraction."""
