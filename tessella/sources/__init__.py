"""Readers of record text."""
