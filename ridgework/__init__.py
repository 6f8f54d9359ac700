"""Part of the ridgework engine."""
