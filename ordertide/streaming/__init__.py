"""Structured Streaming jobs over the milestone event stream."""
