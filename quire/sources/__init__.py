"""Readers of captured pages and writers of books."""
