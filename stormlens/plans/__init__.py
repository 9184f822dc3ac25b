"""Catalog jobs: one function per table, composed from the operators."""
