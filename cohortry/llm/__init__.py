"""Operators for preparing training text: quality, safety, near and exact duplicates, extraction, archives, packing."""
