"""Conform drifting monthly sources, check their quality, and answer questions, on Spark."""
