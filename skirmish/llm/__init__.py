"""Operators over text corpora for training data, one module each; nothing outside imports this package."""
