"""Readers, bar builders and keyed writers."""
