"""Input that arrives over time."""
