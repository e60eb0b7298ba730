"""Readers, writers, and the mapping of the given tables to domain tables."""
