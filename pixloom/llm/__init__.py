"""Operations of a training-data pipeline: filters, deduplication, decontamination, encoding."""
