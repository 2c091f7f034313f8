"""Queries: the predicate tree, the dialect's parser, and the compiler to DataFrames."""
