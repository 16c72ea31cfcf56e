"""Operators for text and labels of training data; nothing outside this package imports it."""
