"""Operators over messages, facts, summaries and stored results: each takes and returns DataFrames."""
