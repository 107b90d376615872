"""Taxonomic sequence classification as Spark DataFrame operators."""
