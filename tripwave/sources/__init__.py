"""Readers and writers for trip samples, metadata, labels, logs and stage tables."""
