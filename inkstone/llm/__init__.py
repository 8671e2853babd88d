"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``inkstone.llm.queries`` holds the
registered queries and their oracle SQL.
"""
