"""quarry: Spark-native document retrieval and answer evaluation."""
__version__ = "0.1.0"
