"""Operations of a training-data pipeline: packing, search, deduplication, mixing, classifiers, token counts."""
