"""Streams: the same checks and windows over unbounded input."""
