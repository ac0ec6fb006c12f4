"""quillstrata: a Spark-native engine for stores of research notes."""

__version__ = "0.1.0"
