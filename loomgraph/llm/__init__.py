"""Operators for preparing large-scale training text, each a Spark job.

Nothing outside this subpackage imports it; ``registry`` holds the queries.
"""
