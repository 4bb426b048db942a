"""Operators for preparing training data; nothing else in the library imports this subpackage.

The functions that run in Python workers are pickled by value (each module
registers itself), so executors need no copy of the library.
"""
