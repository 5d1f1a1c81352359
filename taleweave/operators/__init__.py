"""Relational operators over book-shaped tables."""
