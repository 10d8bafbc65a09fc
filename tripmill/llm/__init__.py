"""Operators for building training corpora: one module per operator, queries in ``registry``."""
