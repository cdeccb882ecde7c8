"""Timberline: forest-inventory point-cloud analytics on Spark DataFrames."""
