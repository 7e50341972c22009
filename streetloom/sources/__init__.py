"""Readers and writers for graphs and element tables."""
