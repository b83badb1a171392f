"""Operators on whole tensors: reshaping, pruning and storage layouts."""
