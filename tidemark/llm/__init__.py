"""Operators for large training corpora: archives, scoring, cleaning, matching, mixing, sharding and packing."""
