"""Whole pipelines, and the queries registered with the driver."""
