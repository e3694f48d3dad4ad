"""Encoding, training, evaluation, explanation and scoring on MLlib."""
