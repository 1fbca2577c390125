"""Training-data operators: search, dedup, tokens, mixing, filtering, extraction."""
