"""Structured Streaming ingest, deduplication, status folds and watchdogs."""
