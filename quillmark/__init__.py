"""Retrieval and evaluation analytics as DataFrame operators."""
