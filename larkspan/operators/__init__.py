"""Operators: plans compiled to DataFrames."""
