"""Readers, writers and adapters to one shape of question."""
