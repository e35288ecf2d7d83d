"""Ridgeway: linear-feature analytics on rasters and lines, as Spark DataFrames."""

__version__ = "0.1.0"
