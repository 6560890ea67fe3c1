"""quarry: Spark-native file and table analytics."""
__version__ = "0.1.0"
