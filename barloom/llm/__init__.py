"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it; queries and oracle SQL of its
operators live in :mod:`barloom.llm.queries`.
"""
