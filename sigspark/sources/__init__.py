"""Readers of documents and queries."""
