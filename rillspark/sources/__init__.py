"""Readers, writers, table schemas and the fixture views over the test tables."""
