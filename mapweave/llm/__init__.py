"""Training-data operators: deduplication, tokenising, scoring, filtering, sharding, packing.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
