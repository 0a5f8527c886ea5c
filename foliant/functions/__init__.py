"""Scalar functions as column expressions; Python only where the built-ins cannot express them."""
