"""Operators that prepare training text and vectors; nothing outside this package imports it."""
