"""Operators on tables: lines and blocks of text, markup, generated tables, and the state of a clipboard."""
