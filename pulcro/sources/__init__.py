"""Readers: delimited text, workbooks, type promotion and row numbers."""
