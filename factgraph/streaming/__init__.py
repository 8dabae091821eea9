"""Structured Streaming extension: facts that follow changing sources."""
