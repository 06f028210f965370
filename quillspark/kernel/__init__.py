"""Single-document Markdown kernels in plain Python: no Spark imports here.

They run inside Arrow batches; one document is always handled whole, and every
input returns a result.
"""
