"""Operators for training-corpus preparation. Nothing outside this package imports it."""
