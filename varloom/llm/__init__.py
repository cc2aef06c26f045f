"""Operations on training corpora; nothing else in the library imports this."""
