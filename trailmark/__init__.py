"""trailmark: multi-hop evidence retrieval and question-answering data on Spark."""

__version__ = "0.1.0"
