"""Analytics over exam-practice data, and document processing, as Spark plans."""
