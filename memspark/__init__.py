"""Spark-first engine over conversational memory."""
