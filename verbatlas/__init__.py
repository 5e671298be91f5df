"""Corpus and lexicon analytics expressed as Spark DataFrame plans."""
