"""Operations of a training-data pipeline: deduplication, filters, search, packing, sharding and formatting."""
