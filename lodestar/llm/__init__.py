"""Operations of a training-data pipeline: filtering, deduplication, mixing, packing, search."""
