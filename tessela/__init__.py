"""Recommendation analytics as Spark jobs: DataFrames in, DataFrames out."""

__version__ = "0.1.0"
