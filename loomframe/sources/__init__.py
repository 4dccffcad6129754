"""Readers, writers, catalog and table maintenance on open-source Spark alone."""
