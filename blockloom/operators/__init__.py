"""Operators from bytes to pixels, DataFrame in and DataFrame out."""
