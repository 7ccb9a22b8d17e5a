"""Operators on records, vectors and texts for training corpora.

Nothing outside this subpackage imports it."""
