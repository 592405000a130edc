"""Incremental state: resumable search and upserts."""
