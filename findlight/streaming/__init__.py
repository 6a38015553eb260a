"""Structured Streaming: change streams into tables."""
