"""Registered queries and their independent SQL statements."""
