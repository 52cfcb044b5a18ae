"""Market-data features, replay and query on Spark: one declarative plan for batch and stream."""
