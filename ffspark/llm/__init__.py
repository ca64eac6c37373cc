"""Operators for preparing language-model training text. Nothing else in ffspark imports this subpackage."""
