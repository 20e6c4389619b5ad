"""Training-data operators: archives, token files, near-duplicates, mixing, packing and text classifiers.

Nothing outside this subpackage imports it.
"""
