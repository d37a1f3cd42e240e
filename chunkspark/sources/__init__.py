"""Readers, extractors, fingerprints and caches."""
