"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries in :mod:`quillspark.llm.queries` apply
them to the shared tables.
"""
