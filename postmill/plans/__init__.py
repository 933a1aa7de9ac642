"""Queries, their SQL, and end-to-end stages."""
