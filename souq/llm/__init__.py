"""Operators for preparing training text at corpus scale.

Every operator takes DataFrames and column names, keeps to Spark for all
partitioning and shuffling, and returns a DataFrame.  ``queries`` binds them to
the driver tables.  Nothing outside this package imports it.
"""
