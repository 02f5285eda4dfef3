"""Pairwise-comparison analytics on Spark: vote logs, ratings, leaderboards, retrieval and corpus preparation."""
