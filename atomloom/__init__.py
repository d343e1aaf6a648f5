"""Molecular structure analytics as ordinary Spark DataFrames."""
