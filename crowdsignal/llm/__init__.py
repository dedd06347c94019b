"""Training-data operators: quality, packing, secrets, near-duplicates, mixing, chat, leaks, toxicity, fingerprints, HTML."""
