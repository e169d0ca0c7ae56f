"""leafmill: a Spark-native engine for collections of documents."""
