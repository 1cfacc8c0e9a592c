"""Readers, writers and canonical schemas."""
