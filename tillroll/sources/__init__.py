"""Readers, writers, SQL views and staged tables."""
