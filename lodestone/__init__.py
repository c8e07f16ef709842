"""Lodestone: knowledge-base, retrieval and trace analytics on Spark DataFrames."""
