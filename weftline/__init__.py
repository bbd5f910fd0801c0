"""weftline: a dataset engine expressed on Spark DataFrames."""

__version__ = "0.1.0"
