"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Every operator takes DataFrames, reads only the
columns it names (extra columns, clashing names included, are ignored) and returns whole
results.  `queries.py` binds each one to the driver tables.
"""
