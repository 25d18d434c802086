"""Operators and the pipeline for preparing training text.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns
DataFrames; ``catalog`` holds the thin queries that apply them to the whole ``documents`` table.
"""
