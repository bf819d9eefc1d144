"""Structured Streaming: callback batches, counters, pending queues."""
