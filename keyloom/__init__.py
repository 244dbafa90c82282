"""Ordered, key-clustered collections on PySpark."""
