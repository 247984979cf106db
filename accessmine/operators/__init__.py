"""Operators over the four access-rights tables and what is derived from them."""
