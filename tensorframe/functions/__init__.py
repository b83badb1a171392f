"""Formats of tensor levels and how they combine."""
