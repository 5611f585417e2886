"""Spark-first operators for curating, splitting, scoring and comparing reasoning datasets and recorded model rollouts.

Every public operator takes and returns DataFrames; plans stay lazy unless a docstring says that a check or a count is eager.
"""
