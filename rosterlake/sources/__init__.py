"""Landed files -> DataFrames."""
