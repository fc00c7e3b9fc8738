"""Streams: batch triggers and the audit stream."""
