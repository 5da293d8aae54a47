"""Operators for preparing large text corpora.

Thirteen operators, one module each, all on Spark DataFrames; ``queries`` holds
the thin registered queries. Nothing else in the library imports this
subpackage.
"""
