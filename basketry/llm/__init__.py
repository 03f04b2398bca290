"""Operators of a training-data pipeline (documents, pages, embeddings).

Nothing else in the library imports this subpackage.  Every module holds one
operator with its own general interface; `queries` binds each to its table
with production parameters.
"""
