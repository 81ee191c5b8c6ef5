"""Readers, writers and the canonical views over stored tables."""
