"""Readers that return DataFrames, schema discovery, validation and configuration."""
