"""Readers, writers, samples, digests and triples."""
