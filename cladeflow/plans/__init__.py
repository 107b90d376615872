"""Part of the classification engine."""
