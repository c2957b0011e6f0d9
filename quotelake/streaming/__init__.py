"""Incremental processing: what is new, what changed, and windows over events."""
