"""Logs made from the driver tables."""
