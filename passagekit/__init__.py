"""Passage analytics and corpus operators on Spark."""
