"""Operators for text corpora and for pairing their records; nothing else in the library imports this."""
