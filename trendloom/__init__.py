"""Catalog and trend analytics on Spark DataFrames."""
