"""Operators a training-data pipeline needs, each as Spark jobs.

Nothing outside this package imports it. Every operator takes DataFrames and
column names; ``queries.py`` holds the thin registered queries.
"""
