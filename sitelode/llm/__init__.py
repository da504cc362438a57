"""Operations for training-data pipelines: documents, conversations, vectors and raw pages."""
