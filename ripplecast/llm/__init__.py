"""Operators for preparing training data; the named queries are in ``queries``."""
