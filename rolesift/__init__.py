"""Posting ETL on Spark: ingest, filter, score, insert once, decide, learn."""
