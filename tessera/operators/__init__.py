"""Relational operators of the core library."""
