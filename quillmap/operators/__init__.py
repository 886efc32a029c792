"""Relational operators over the tables of schemas.py."""
