"""thriftline: alternative-data credit scoring as Spark DataFrame functions."""
