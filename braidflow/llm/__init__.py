"""Operators for preparing language-model training text. Nothing else in braidflow imports this subpackage."""
