"""Operators for preparing text corpora for training, and their registered queries.

Nothing else in the package imports this folder.
"""
