"""Incremental versions of the ingest and roll-up operators."""
