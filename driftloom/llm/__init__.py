"""Operators for preparing training text: near duplicates, tokens, language, mixing, privacy, search and URL filters.

Nothing outside this subpackage imports it.
"""
