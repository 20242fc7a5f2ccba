"""Lodestone: retrieval, coverage and corpus analytics expressed as Spark DataFrames."""
