"""Registered queries with the SQL they are compared to."""
