"""tessella: a Spark-first engine for building and evaluating retrieval training data."""

__version__ = "0.1.0"
