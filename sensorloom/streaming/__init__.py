"""Structured Streaming: the batch operators on unbounded input, plus what only a stream needs."""
