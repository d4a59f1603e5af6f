"""Similarity retrieval and catalog analytics on Spark DataFrames."""
