"""Identification of file formats at scale, on Spark DataFrames."""

__version__ = "0.1.0"
