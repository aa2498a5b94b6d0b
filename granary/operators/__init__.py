"""Relational and spatial operators as functions on DataFrames and Columns."""
