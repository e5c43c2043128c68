"""Index, search, facets, highlighting, suggestion, expansion and vectors over DataFrames."""
