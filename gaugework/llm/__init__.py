"""Corpus preparation operators; nothing outside this package imports it."""
