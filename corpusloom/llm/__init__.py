"""Training-data operators for large text corpora, each a Spark job over whole tables."""
