"""Training-data operators: sharding, decontamination, packing, quality, near and line
duplicates, exact top-k, HTML extraction, secret scans and toxicity."""
