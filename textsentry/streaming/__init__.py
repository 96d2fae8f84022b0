"""Incremental scans: batch resume and Structured Streaming."""
