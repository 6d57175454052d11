"""specloom: API contracts from HTTP traffic, computed with Spark DataFrames."""

__version__ = "0.1.0"
