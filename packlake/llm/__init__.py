"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; the queries over it are in
``packlake.llm.queries``.
"""
