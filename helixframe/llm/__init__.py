"""Operators of a training-data pipeline: search, counting, filtering, near-dedup, scoring, packing, encoding, sharding.

Nothing else in the library imports this package.
"""
