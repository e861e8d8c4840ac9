"""Operators of the feature pipeline: each takes and gives lazy DataFrames."""
