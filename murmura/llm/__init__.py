"""Operators for training data: text, tokens and vectors. Nothing else in the library imports this subpackage."""
