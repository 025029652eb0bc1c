"""Structured Streaming jobs over the append and erase logs."""
