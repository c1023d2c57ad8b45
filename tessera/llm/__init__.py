"""Training-data operators: dedup, retrieval, mixing, packing, extraction, safety.

Nothing outside this folder imports it; ``queries`` registers its queries.
"""
