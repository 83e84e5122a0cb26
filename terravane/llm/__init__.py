"""Operators for preparing training data of language models; nothing outside imports them."""
