"""Plans of the dataset engine."""
