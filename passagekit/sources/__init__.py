"""Readers and the transcript catalog as tables."""
