"""Readers and writers of graph formats, and graphs over the star-schema tables."""
