"""Structured Streaming forms of the message and conversation operators."""
