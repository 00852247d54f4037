"""Operators on DataFrames with named columns, for code graphs and any other tables."""
