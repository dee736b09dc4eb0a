"""Stored indices and shared storage."""
