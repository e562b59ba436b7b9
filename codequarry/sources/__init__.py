"""Readers of source trees, documents, snapshots and landed service data."""
