"""Structured Streaming entry points: the stateless transforms over unbounded input."""
