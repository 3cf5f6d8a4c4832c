"""Operators of large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the modules' docstrings state how nulls, empty inputs, ties and
repeated rows are treated.
"""
