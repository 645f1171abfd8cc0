"""Retrieval for streams of query records."""
