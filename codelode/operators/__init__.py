"""Relational operators over files, commits and repositories."""
