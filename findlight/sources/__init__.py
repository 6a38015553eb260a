"""Readers, schema inference, bulk loads and stored generations."""
