"""Readers of landed files and parsers of text and record columns. Fetching is left to the user."""
