"""Compositions of operators: ingest, persist, enrich."""
