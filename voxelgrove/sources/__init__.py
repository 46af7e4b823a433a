"""Sources of the dataset engine."""
