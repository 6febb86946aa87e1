"""Corpus analytics on Spark: search, fusion, chunking, event logs, graphs and merges as DataFrames."""
