"""Incremental re-runs."""
