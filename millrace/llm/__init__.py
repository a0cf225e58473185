"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and has its own general interface; ``queries`` holds the thin
registered queries on top of them.
"""
