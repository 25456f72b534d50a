"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Common rules, unless an operator says otherwise: a null text counts as empty, a null id is a value like any
other, rows that repeat are each answered, an empty table gives an empty result, and input columns that the
operator does not name are either carried in a struct or left out, so their names cannot clash.
"""
