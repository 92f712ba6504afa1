"""Operators for large-scale training-data preparation.

Each operator keeps a general interface (DataFrame in, DataFrame out) in its own module;
``registry`` turns them into the queries that ``__spark_entry__`` registers.
"""
