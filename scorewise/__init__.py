"""Score-series, retrieval and evaluation analytics as Spark DataFrame operators."""
