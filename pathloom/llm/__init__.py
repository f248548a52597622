"""Operations for training-data corpora, each a DataFrame job of its own."""
