"""Operators on documents."""

from __future__ import annotations


def all_rules() -> dict:
    """Every registered rule by its id."""
    from . import blocks, catalogs, comments, grammar, mannerisms, native_grammar, prose, structure, styles  # noqa: F401  they register on import
    from .registry import RULES

    return RULES
