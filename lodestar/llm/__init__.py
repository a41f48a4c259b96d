"""Operators that a large-scale training-data pipeline needs.

Nothing outside this subpackage imports it; ``queries`` and ``oracle`` hold the
registered queries and the SQL that checks them.
"""
