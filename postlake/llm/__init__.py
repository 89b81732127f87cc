"""Operators for preparing training text: deduplication, joins, tokens, scans, search, extraction, pseudonyms."""
