"""Operators over DataFrames with an x and a y column."""
