"""Structured Streaming monitors and stream sinks."""
