"""Training-data operators: search, quality, dedup, tokens, packing, toxicity."""
