"""Structured Streaming counterparts of the arrival operators."""
