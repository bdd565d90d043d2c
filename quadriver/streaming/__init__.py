"""Change feeds and subscriptions over a growing table of values."""
