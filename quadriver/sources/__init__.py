"""Readers and writers of the formats that values come and go in."""
