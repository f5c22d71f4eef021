"""siftlake: hybrid text and code retrieval, and data preparation, as Spark plans."""
