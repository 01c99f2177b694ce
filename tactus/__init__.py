"""Tactus: structure analytics over time-indexed signals, expressed as Spark DataFrames."""
