"""Operators of the dataset engine."""
