"""Structured Streaming versions of the stateless and counting operators."""
