"""Operators of the resale-price library."""
