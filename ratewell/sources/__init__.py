"""Readers and writers of the append-only result logs."""
