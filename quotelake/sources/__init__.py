"""Readers and writers: files of all kinds to DataFrames with declared schemas, and idempotent writes."""
