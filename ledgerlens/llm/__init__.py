"""Operators for preparing training data; nothing outside this folder imports it."""
