"""Dataset analytics for multi-modality array samples, as Spark DataFrames."""

__version__ = "0.1.0"
