"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries`` holds the registered queries and SQL.
Nothing outside this subpackage imports it.
"""
