"""Text analytics for long-form text on Spark DataFrames."""

__version__ = "0.1.0"
