"""Readers and writers for the archive, feeds and catalog tables."""
