"""Operators of a training-data pipeline. Nothing else in this library imports this subpackage."""
