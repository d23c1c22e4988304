"""Operators for preparing training data, and the pipeline made of them."""
