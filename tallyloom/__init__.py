"""Retail register analytics on PySpark: see README.md."""
