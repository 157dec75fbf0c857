"""Operators for preparing language-model training data (nothing else in vartide imports this)."""
