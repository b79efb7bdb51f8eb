"""Structured Streaming forms of the extraction half."""
