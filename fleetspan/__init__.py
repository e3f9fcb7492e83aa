"""Connected-vehicle telemetry analytics on Spark: panels, windows, as-of joins, splits and alert metrics."""
