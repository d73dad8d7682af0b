"""Ranked-activity analytics on Spark DataFrames."""
