"""Readers, writers and bindings of existing tables to the snapshot model."""
