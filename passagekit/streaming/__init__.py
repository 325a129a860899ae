"""Keyed state and streams."""
