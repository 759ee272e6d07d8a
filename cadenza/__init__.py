"""cadenza: time-series relational operators for multi-sensor recordings, on Spark."""
