"""Indexing of documents as they arrive, with Structured Streaming."""
