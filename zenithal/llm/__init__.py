"""Operators for building training data: quality, archives, privacy, token files, near-duplicates, filters, media, mixing.

Nothing outside this subpackage imports it.
"""
