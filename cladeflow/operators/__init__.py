"""Relational operators over alignments, predictions and bins."""
