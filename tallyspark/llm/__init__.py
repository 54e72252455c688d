"""Operators for preparing language-model training corpora, as Spark jobs.

Nothing else in the package imports this subpackage.
"""
