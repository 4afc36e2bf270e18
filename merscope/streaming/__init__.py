"""Sketches of streams of sequences."""
