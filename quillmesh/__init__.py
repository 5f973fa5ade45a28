"""Set-at-a-time analytics over text knowledge graphs, written for Spark DataFrames."""

__version__ = "0.1.0"
