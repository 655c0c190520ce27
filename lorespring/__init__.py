"""Retrieval over documents, written for Spark."""
