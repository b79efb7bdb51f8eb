"""Registered queries over the provided tables, with their oracle SQL."""
