"""Operators for large training-data corpora.

One module per operator; :mod:`.queries` registers the ``opN_<name>``
queries over the tables. Nothing outside this package imports it.
"""
