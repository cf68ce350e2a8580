"""Structured Streaming versions of the folds and windows."""
