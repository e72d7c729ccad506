"""Readers: index tables, repository walks and change feeds."""
