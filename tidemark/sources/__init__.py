"""Readers that turn tables and files into facts, and writers of results."""
