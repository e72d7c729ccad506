"""The registry of runnable queries and their SQL oracles."""
