"""Training-data operators: archives, classifiers, dedup, scoring and token files.

Nothing outside this subpackage imports it.  Operators take DataFrames and return
DataFrames; ``queries.py`` binds each one to the project's tables.
"""
