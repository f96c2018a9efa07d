"""Training-data operators: sharding, near-duplicates, mixing, licences, quality, lines, scoring, token files, toxicity, decontamination."""
