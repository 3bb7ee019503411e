"""Operators for text corpora on their way to model training; nothing else in the library imports them."""
