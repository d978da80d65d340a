"""A PySpark-native engine for long, error-prone sequence data.

Every operator takes and returns DataFrames and runs no hidden job unless its
docstring says so.
"""
