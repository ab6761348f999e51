"""Conversation memory on Spark: building, searching and scoring it for all conversations at once."""
