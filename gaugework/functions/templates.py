"""User surface: function templates for fits, and parameter normalisation by formula text."""

from __future__ import annotations

from pyspark.sql import Column

from gaugework.operators.fit import TEMPLATES, formula, register_template

__all__ = ["TEMPLATES", "formula", "normalisation", "register_template"]


def normalisation(text: str, param: str) -> Column:
    """A normalisation formula over ``parameter(name)``; no coefficients are allowed."""
    column, used = formula(text, lambda i: None)
    if used:
        raise ValueError("a normalisation has no coefficients")
    return column.alias(param)
