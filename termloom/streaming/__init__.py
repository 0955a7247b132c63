"""Structured Streaming forms of the append-as-you-go steps."""
