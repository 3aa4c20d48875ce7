"""Whole plans made of operators: the two-phase projection."""
