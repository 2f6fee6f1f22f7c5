"""Event-time operators on streams."""
