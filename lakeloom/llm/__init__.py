"""Operators of a training-data pipeline over document tables.

Each module holds one operator with its own interface; ``queries.py`` binds
them to the given tables as ``opN_<name>``. Nothing else in the library
imports this subpackage.
"""
