"""koine: a Spark-native engine for curating speech corpora and text training data."""
