"""Structured Streaming form of the detection scan."""
