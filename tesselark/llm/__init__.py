"""Operators for preparing training data: text, media, embeddings and pages.

Nothing outside this subpackage imports it.  Every public operator takes a
DataFrame and returns a DataFrame; the thin queries that the entry module
registers are in :mod:`tesselark.llm.queries`.
"""
