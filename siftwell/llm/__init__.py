"""Training-data operators: de-duplication, filtering, tokenising, packing, search."""
