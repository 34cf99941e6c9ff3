"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``lodestar.llm.queries`` registers the thin ``opN_<name>`` queries and their SQL.
"""
