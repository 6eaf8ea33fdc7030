"""siltgrove: hierarchical retrieval analytics over text corpora, written for Spark."""
