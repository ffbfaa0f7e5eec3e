"""Analysis of source code and text corpora with Spark."""
