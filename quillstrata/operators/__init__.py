"""Operators: pure DataFrame in, DataFrame out."""
