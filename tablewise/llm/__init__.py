"""Operators for preparing training text: quality, duplicates, mixing, tokens, extraction, scoring."""
