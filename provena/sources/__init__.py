"""Readers and writers for registry tables, documents, images, reports and event streams."""
