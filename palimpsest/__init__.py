"""palimpsest: a Spark-native engine for masking recoverable text in paged documents."""
