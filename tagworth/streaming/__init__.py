"""Streaming of the resale-price library."""
