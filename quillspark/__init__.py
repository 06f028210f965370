"""Quillspark: document analytics on Spark.

Markdown documents become a node table; extraction, statistics, checks and
rendering are relational operators over it.
"""
