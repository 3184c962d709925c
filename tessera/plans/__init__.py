"""Composed query plans."""
