"""Orrery: graph and social-network analytics on Spark DataFrames."""
