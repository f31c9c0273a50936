"""Paired, bilingual answer evaluation and benchmark construction as Spark plans."""
