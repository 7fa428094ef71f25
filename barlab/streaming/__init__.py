"""Micro-batch entry point of the keyed prediction writer."""
