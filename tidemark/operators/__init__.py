"""Operators over fact tables: analyses, graph kernels and hierarchies."""
