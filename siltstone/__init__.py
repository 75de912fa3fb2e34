"""Conversation-compaction analytics as Spark DataFrame operators."""
