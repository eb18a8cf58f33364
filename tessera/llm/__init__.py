"""Operators of a training-data pipeline over whole document tables.

Nothing else in the library imports this subpackage.
"""
