"""figloom: Spark-native curation and multi-level search for documents and their figures."""
