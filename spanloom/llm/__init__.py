"""Operators on source text and documents for training data. Nothing outside this package imports it."""
