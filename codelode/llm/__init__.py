"""Operators for building training data from the index. Nothing outside this subpackage imports it."""
