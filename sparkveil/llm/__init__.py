"""Training-data operators: filters, archives, extraction, deduplication, mixing and packing."""
