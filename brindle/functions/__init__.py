"""Column functions: vectors, text and BM25, filters."""
