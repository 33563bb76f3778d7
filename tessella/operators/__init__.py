"""Relational steps of columnising and encoding records."""
