"""Training-data operators: near-duplicates, repeats, search, scoring, scanning, formatting and packing.

Nothing outside this subpackage imports it.
"""
