"""Text-authenticity analytics on Spark: DataFrame-in, DataFrame-out operators."""
