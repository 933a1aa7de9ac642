"""Absent by design: the data model is batch, and no operator here claims streaming semantics.

The column functions of ``postmill.functions`` are stateless and work on streaming DataFrames as they are.
"""
