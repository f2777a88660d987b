"""Training-data operators: cleaning, deduplication, tokenisation, scoring and packaging of text corpora."""
