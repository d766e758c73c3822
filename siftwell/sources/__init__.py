"""Readers, writers and constant tables."""
