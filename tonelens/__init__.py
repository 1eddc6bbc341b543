"""Text moderation analytics on Spark: DataFrame in, DataFrame out."""
