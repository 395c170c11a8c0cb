"""Operators on training text and on record similarity; nothing outside imports this."""
