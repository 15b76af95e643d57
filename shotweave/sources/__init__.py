"""Readers, writers and the corpus derived from the given tables."""
