"""Readers for session logs and tables, and their sinks."""
