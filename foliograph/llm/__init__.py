"""Training-data operators: dedup, quality, languages, decontamination, mixing, scoring."""
