"""Training-data operators: search, tokenising, formatting, scoring, deduplication, mixing, filtering, media."""
