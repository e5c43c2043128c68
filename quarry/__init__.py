"""A search and document-analytics engine on Spark DataFrames."""
