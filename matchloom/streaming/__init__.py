"""Structured Streaming forms of admission and price refresh."""
