"""Readers of registers, and what is kept beside them."""
