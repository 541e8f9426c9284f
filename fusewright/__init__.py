"""Record consolidation and corpus processing on Spark DataFrames."""

__version__ = "0.1.0"
