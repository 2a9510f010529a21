"""Training-data operators: search, classifiers, deduplication, tokenizing and packing.

Self-contained: nothing else in the library imports this subpackage.
"""
