"""Operators for preparing training text: sharding, duplicate search, quality, licences, tokens, scores.

Nothing else in the library imports this subpackage.
"""
