"""Readers, writers and the feed made from the driver tables."""
