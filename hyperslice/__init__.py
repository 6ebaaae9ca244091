"""hyperslice: n-dimensional slice, filter, reduce and level-of-detail analytics on Spark DataFrames."""

__version__ = "0.1.0"
