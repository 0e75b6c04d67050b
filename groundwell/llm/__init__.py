"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator: a general function with real outputs, and a thin ``query`` on top of
it that returns the digest columns of the query contract.
"""
