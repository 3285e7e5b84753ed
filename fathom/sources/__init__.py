"""Readers and generators of price tables."""
