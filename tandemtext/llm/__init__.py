"""Operators on texts for the preparation of training data for language models."""
