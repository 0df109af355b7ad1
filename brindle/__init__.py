"""Analytics operators declared as Spark DataFrame, SQL and Structured Streaming plans."""
