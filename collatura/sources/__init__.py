"""Readers, writers and what guards them."""
