"""Streaming forms of the mergeable statistics."""
