"""Operators of a training-data pipeline (deduplication, mixing, tokenising, scoring, sharding).

Nothing else in the library imports this subpackage; ``catalog`` registers its queries.
"""
