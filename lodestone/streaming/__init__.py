"""Structured Streaming over the event log (an addition: the batch operators have no streams)."""
