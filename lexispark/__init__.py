"""Batch text retrieval on Spark: inverted index tables, BM25 ranking, term, boolean and phrase queries."""
