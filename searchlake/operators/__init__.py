"""Operators over DataFrames: text indexes, mutations, vector indexes, ordered maps and ranking."""
