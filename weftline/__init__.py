"""weftline: session-log analytics and record preparation, written for Spark's DataFrame engine."""
