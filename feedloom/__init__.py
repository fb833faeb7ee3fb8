"""Feed tables on Spark: parse, clean, rank and emit messy endpoint feeds."""
