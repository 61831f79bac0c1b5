"""recalloom: chunking, retrieval and recall evaluation of text corpora as Spark DataFrames."""

__version__ = "0.1.0"
