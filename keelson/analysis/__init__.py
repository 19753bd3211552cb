"""Diagnostics over run-time metrics and query plans."""
