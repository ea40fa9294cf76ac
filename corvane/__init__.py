"""Corvane: source-review analytics and text-corpus operators on Spark DataFrames."""
