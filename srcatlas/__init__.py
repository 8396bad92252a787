"""Analytics of source-code and document corpora on Spark."""
