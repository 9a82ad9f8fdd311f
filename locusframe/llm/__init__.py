"""Operators for building training corpora, written as Spark jobs."""
