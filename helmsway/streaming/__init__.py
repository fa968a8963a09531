"""Structured Streaming versions of the order-sensitive operators."""
