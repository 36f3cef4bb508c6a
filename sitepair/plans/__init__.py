"""Whole jobs: the engine, the registered queries and their SQL."""
