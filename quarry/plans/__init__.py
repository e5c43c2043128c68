"""Schemas, the query algebra, its language and the compiler to DataFrames."""
