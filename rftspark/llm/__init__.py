"""Operators on training-data text: deduplication, packing, tokens, language, quality, nearest neighbours."""
