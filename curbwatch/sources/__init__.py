"""Readers and writers for the landed documents and tables."""
