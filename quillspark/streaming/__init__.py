"""Stateless parsing of document streams, and watermarked counts over events."""
