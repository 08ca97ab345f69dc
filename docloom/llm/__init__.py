"""Operators for training data of language models.

Each module is one problem: ``spans`` (1), ``truncation`` (2), ``neardup`` (3),
``splitting`` (4), ``canonical`` (5), ``sentences`` (6), ``tokens`` (7),
``mixing`` (8), ``reading`` (9).  ``queries`` registers them.
"""
