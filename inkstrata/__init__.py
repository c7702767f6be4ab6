"""Manuscript and corpus analytics as plain DataFrame-to-DataFrame operators."""
