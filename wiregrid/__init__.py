"""News-feed analytics on Spark: ingest, score, group and digest short texts."""
