"""Readers, writers and table shapes."""
