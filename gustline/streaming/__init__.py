"""Structured Streaming forms of the hourly panel."""
