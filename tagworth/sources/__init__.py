"""Sources of the resale-price library."""
