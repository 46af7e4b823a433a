"""Functions of the dataset engine."""
