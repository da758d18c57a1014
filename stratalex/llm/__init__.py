"""Operators for training-data pipelines over ``documents`` and ``pages``.

Nothing outside this folder imports it.  Queries and their SQL are in
:mod:`stratalex.llm.queries`.
"""
