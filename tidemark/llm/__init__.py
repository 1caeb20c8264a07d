"""Training-data operators: scoring, de-duplication, filtering, mixing and sharding of text corpora."""
