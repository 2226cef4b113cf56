"""Functions of the resale-price library."""
