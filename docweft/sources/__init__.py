"""Readers that yield DataFrames."""
