"""Operators on change logs and tables made of them."""
