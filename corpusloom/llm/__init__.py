"""Corpus preparation for language-model training. Nothing outside this folder imports it."""
