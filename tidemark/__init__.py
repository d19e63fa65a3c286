"""Scored-signal analytics on Spark DataFrames."""
