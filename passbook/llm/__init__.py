"""Training-data operators for text corpora: dedup, scoring, mixing, sharding, chat threads."""
