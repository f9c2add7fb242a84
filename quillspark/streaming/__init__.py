"""Incremental indexing with Structured Streaming (an extension; batch is the main path)."""
