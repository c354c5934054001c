"""Operators for preparing language-model training data at corpus scale.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` applies each to its table with production
parameters.
"""
