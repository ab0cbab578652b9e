"""Similarity-map analytics on Spark: distances, scaling layouts, neighbourhood graphs and rating statistics as DataFrames."""

__version__ = "0.1.0"
