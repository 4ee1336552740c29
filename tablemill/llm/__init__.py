"""Operators for training-data pipelines over large text corpora.

Nothing else in the library imports this subpackage. Each module holds one operator with an interface of its own;
``suite`` registers the queries that apply them to whole tables.
"""
