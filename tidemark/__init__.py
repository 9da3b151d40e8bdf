"""tidemark: historical market-pattern, document and corpus analytics on Spark."""
