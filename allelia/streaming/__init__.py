"""Structured Streaming versions of mergeable operators."""
