"""codelode: a Spark-native analytics engine for code indexes and the text corpora built from them."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
