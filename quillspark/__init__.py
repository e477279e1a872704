"""quillspark: a Spark-native document analytics and retrieval engine."""
