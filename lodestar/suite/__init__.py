"""Queries by subject; importing a module adds its queries to the registry."""
