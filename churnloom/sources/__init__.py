"""Readers, writers and the customer table derived from order data."""
