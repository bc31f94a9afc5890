"""Training-data operators: scoring, packing, deduplication and fixity over documents."""
