"""Derived inputs: keyed, ordered series made from plain tables."""
