"""pagemill: a Spark-native engine for corpora of paged documents."""
