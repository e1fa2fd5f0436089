"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this package.  Each module holds one
operator with its own general interface; ``queries`` derives the registered
``opN_<name>`` queries from them.
"""
