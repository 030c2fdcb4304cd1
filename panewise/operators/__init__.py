"""Keyed windowed sets, ordered folds, sketches and the evaluation kit."""
