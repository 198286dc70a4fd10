"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` derives the fixed-column
queries from them and ``oracles`` holds SQL where SQL can state the result.
"""
