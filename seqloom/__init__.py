"""Sequence analytics and lossless sequence compression on Spark DataFrames."""

__version__ = "0.1.0"
