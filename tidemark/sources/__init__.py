"""Loaders with explicit schemas."""
