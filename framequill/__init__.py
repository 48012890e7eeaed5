"""Framequill: ordered-sequence and corpus analytics expressed as Spark plans."""
