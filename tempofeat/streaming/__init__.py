"""Applying a fitted pipeline to a stream of events."""
