"""srcquarry: a Spark-native index and processing engine for source code and Markdown."""

__version__ = "0.1.0"
