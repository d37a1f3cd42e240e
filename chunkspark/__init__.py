"""A PySpark-native engine that prepares text corpora for retrieval."""

__version__ = "0.1.0"
