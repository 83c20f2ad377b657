"""Structured Streaming jobs and the sequential folds they share with batch."""
