"""quillspark: full-text indexing and ranking on Spark DataFrames."""
