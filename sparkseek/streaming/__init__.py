"""Structured Streaming ingestion and windowed counts."""
