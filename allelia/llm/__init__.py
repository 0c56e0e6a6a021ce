"""Corpus-preparation operators for training data at scale; nothing outside this package imports it."""
