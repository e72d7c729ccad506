"""Relational, graph and maintenance operators over the code index."""
