"""Readers and landed snapshots."""
