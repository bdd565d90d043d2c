"""Relational operators over the canonical table."""
