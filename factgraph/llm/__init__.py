"""Operators for large training corpora: one module each, on plain Spark DataFrames.

Nothing outside this package imports it.  ``queries`` registers one query per operator.
"""
