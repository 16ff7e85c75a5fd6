"""Operators for building language-model training data; nothing outside this package imports it."""
