"""Readers and writers: manifests, tables, catalog, metadata, vectors, logs."""
