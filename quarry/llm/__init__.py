"""Operators for large training-data pipelines, with the queries that apply them.

Each ``opN`` module holds one operator with its own general interface; ``registry`` binds the
operators to tables as the ``opN_<name>`` queries.
"""
