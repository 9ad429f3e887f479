"""Operators for preparing text corpora: archives, quality, toxicity, duplicates, secrets, mixing, packing."""
