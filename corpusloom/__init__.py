"""Corpus-to-knowledge-graph jobs on Spark DataFrames."""
