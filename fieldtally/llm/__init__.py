"""Operators for the preparation of training data: tokens, near duplicates, quality, personal data, mixing."""
