"""DataFrame in, DataFrame out. Used unchanged on tables and, where Spark allows, on streams."""
