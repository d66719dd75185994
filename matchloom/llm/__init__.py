"""Training-data operators: cleaning, near-duplicates, personal data, mixing, formatting and packing of text corpora."""
