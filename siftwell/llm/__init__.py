"""Operators of a training-data pipeline: near-duplicates, packing, tokens, pages and chats."""
