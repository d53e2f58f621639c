"""Streaming ingest: an extension, files that arrive become chunks and index rows as they come."""
