"""Operators for preparing language-model training text.

One module per operator; each takes DataFrames and returns DataFrames, and
carries the query that applies it to a whole table.  ``registry`` lists the
queries.  Nothing outside this package imports it.
"""
