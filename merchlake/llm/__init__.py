"""Operators for preparing training text: quality, packing, sharding, filters, joins and deduplication."""
