"""Relational operators over (key, value, lo, hi) facts."""
