"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface; ``queries`` binds
them to the tables ``documents``, ``pages`` and ``embeddings``.  Nothing outside
this subpackage imports it.
"""
