"""Training-data operators: archives, dedup, quality, mixing, packing.

Self-contained: nothing else in the library imports this subpackage, and the
rest of the library works without it.
"""
