"""outrider: medallion pipelines, leakage-safe features, scoring and evaluation on Spark."""
