"""seqloom: Spark-native sequence homology search."""

__version__ = "0.1.0"
