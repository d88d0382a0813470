"""Training-data operators: scoring, filtering, tagging, deduplication and tokenisation."""
