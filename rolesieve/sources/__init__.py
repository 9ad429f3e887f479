"""Readers, writers and feed mappings."""
