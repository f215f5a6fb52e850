"""Relational operators over the tables of a corpus."""
