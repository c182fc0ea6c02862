"""Operations of a training-data pipeline over document and conversation tables."""
