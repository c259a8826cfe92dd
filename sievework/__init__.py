"""sievework: a Spark-native engine for text retrieval, scoring, evaluation and data preparation."""
