"""Operators over Markdown documents and their node table."""
