"""Operators on text corpora for language-model training; nothing outside this package imports it."""
