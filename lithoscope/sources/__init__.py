"""Readers of spectrum and crystal files and of the merged table, and the writers of result tables."""
