"""Quarry: archive and media-container forensics on Spark DataFrames."""
