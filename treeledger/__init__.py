"""Snapshot and change analytics over tables of versioned trees, on Spark DataFrames."""

__version__ = "0.1.0"
