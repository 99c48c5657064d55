"""Lecture and document analytics on Spark: a knowledge graph, retrieval over it, and what evaluates both."""
