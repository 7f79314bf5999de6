"""Readers with declared schemas, lookups and sinks."""
