"""Expressions, their rewrites, and their lowering to DataFrames."""
