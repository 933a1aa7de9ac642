"""Readers, unions, schemas and sinks."""
