"""Operators over the relations files, lines, nodes, functions, messages and findings."""
