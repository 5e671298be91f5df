"""Functions of the corpus and lexicon engine."""
