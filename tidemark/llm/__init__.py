"""Operators for training-data corpora: filtering, near duplicates, decontamination, archives."""
