"""Training-data pipeline operators: quality, deduplication, scoring, packing and sharding."""
