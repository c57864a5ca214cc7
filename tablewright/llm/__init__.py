"""Operators for preparing training text and vectors; nothing outside this folder needs them."""
