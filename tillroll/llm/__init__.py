"""Operators for building training corpora: extraction, filtering, deduplication, tokenising."""
