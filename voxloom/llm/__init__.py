"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing else in the library imports this package.  Each module holds one
operator; ``queries`` registers one query per operator.
"""
