"""Operators for building training corpora: filters, scores, tokenisation, joins.

Nothing outside this subpackage imports it.
"""
