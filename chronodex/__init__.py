"""chronodex: time-aware retrieval analytics over project knowledge, on Spark."""

__all__ = ["session", "tables"]
