"""Incremental state: upserts, watermarks, streams."""
