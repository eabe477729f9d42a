"""Pairwise comparison studies and training-data preparation as Spark plans."""
