"""Incremental ingest as streaming jobs. The batch merge stays authoritative."""
