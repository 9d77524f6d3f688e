"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only where it can be imported.
"""
