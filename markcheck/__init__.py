"""Markup-corpus diagnostics on Spark DataFrames."""
