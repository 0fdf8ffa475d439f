"""Queries by name, composed from the operators."""
