"""Operators for training-data pipelines: deduplication, decontamination, licences, search, packing, classifiers."""
