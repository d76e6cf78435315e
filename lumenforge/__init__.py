"""lumenforge: a Spark-native engine for document matching, grouping, ranking and graph alignment."""
