"""Spark-native training and scoring of small feed-forward networks."""
