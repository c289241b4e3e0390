"""Operators for building training corpora: scans, filters, duplicates, tokens, packing."""
