"""Operators for preparing training text: packing, deduplication, language, privacy, quality, mixing and search."""
