"""Readers of exported listings, stored results and table files."""
