"""Camera attention on Spark: ingest, match, baseline, score and rank roadside cameras."""
