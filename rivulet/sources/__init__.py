"""Readers and writers of flow records."""
