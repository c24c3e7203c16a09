"""Corpus operators for language-model training data (see the README)."""
