"""Registered queries and their oracle statements."""
