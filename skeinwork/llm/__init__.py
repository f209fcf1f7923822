"""Training-data operators: deduplication, packing, encoding, filtering, search and counting."""
