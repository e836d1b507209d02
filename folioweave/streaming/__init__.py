"""Structured Streaming jobs; each has a batch form it is compared with."""
