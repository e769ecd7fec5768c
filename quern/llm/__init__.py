"""Training-data operators: filtering, deduplication, mixing, tokenisation and formatting."""
