"""Structured Streaming jobs: ingest, incremental rollups, alert state, template state."""
