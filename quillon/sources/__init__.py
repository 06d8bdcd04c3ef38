"""Readers of the input tables, and payloads made from them."""
