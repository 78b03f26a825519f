"""Helpers that shape physical plans: staged tables and composed queries."""
