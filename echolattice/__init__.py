"""Similarity retrieval and sequence analytics on Spark DataFrames."""
