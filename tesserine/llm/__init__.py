"""Training-data operators: de-duplication, scoring, mixing, packing and token output.

Nothing outside this package imports it; ``queries`` registers the queries.
"""
