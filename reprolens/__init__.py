"""Reproducibility analytics over study artifacts, expressed as lazy Spark DataFrames."""
