"""Operators for preparing large text corpora for model training.

Every operator is a Spark job over a DataFrame with a ``text`` column; nothing else in
the library imports this subpackage.
"""
