"""Quern: data processing for marketplace search on Spark DataFrames."""
