"""Operators for training-data pipelines over text, URLs, chats and vectors."""
