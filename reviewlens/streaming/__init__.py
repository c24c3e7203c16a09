"""Incremental (streaming) ingest."""
