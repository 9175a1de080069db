"""Readers and writers under explicit schemas."""
