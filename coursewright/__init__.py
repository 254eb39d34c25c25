"""coursewright: a Spark-native engine for corpora of course material."""

__version__ = "0.1.0"
