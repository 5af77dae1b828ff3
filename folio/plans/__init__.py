"""Filters as values and the plans made of them."""
