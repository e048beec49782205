"""Operators for building training corpora (see README, "Training-data operators").

Nothing else in the library imports this subpackage.
"""
