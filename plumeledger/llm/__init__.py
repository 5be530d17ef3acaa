"""Operators for large-scale text corpora: one module each, with its query; nothing else in the library imports them."""
