"""Training-data operators: language ID, near-duplicates, decontamination,
secret scans, packing, token output and counts, toxicity, quality, search.

Nothing outside this subpackage imports it.
"""
