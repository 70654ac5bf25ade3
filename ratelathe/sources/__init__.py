"""Readers and writers of raw, processed and run-artifact data."""
