"""Training-data operators: deduplication, filtering, labelling, formatting and tokenising text at scale."""
