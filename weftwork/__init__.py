"""weftwork: a PySpark-native multimodal retrieval and analytics engine."""

__version__ = "0.1.0"
