"""Operators that prepare text corpora for model training, as Spark jobs."""
