"""Entity-month analytics on Spark: panels, splits, features, models, capacity metrics."""
