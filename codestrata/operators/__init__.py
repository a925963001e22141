"""Relational operators over evidence tables.  Each takes DataFrames and returns a DataFrame; nothing is collected."""
