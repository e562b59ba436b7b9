"""Structured Streaming forms of the event aggregates and of incremental refresh."""
