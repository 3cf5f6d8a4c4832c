"""A Spark-native engine that triages what tools return to agents, and prepares the data it learns from."""
