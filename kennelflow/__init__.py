"""Listing intelligence on Spark: DataFrame operators for messy, repeatedly delivered records."""
