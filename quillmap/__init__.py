"""Transcript-to-knowledge-graph analytics as DataFrame plans."""
