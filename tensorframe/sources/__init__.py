"""Readers and writers of coordinate text."""
