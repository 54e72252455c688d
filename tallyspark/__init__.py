"""Analytics over account statements on Spark, with optional corpus operators in `llm`."""
