"""Operations over whole tables."""
