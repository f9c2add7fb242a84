"""Index, search, pruning and audit operators over DataFrames."""
