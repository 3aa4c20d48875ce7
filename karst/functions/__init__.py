"""Distances as expressions and as numpy blocks, of dense, sparse and scalar values, with gradients."""
