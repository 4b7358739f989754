"""Query objects and how they become DataFrames."""
