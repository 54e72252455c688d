"""Relational operators over statements, transactions, files and messages."""
