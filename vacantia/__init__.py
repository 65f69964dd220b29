"""Job-market analytics on Spark: DataFrame-in, DataFrame-out operators."""
