"""Spark-native analytics over reasoning traces, rewards, serving events and the text around them."""
