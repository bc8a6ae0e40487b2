"""tidegrid: a Spark-native engine for dense, regularly sampled, multichannel signals."""
