"""Readers, writers and small-file settings."""
