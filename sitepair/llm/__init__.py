"""Training-data operators: mixing, filters, deduplication, tokenisation, search."""
