"""Operators for preparing training data: archives, filters, extraction, near duplicates, packing, search."""
