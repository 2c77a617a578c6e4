"""Readers, input checks and writers."""
