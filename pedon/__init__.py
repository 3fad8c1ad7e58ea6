"""Soil and land analytics on Spark DataFrames."""
