"""Readers, sinks and the ingest manifest."""
