"""Replay of editions as a stream."""
