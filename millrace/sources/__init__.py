"""Readers, writers, caches and providers."""
