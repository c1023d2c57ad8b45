"""Full-text search: tokenizers, inverted index, query language and bm25 ranking, as DataFrames."""
