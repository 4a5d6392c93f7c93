"""Operators for preparing large text corpora for training.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds
its queries when it can be found.
"""
