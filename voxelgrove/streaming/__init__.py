"""Streaming of the dataset engine."""
