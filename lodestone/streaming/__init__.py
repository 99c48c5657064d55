"""Streams of new sources."""
