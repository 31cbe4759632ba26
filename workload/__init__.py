"""Registered queries: each one Spark job with, where SQL can say it, its check."""

from __future__ import annotations


def catalog():
    """name → (query, check SQL or None)."""
    from . import flagship, grading, prompting, sampling, training  # noqa: F401
    from .base import CATALOG

    return CATALOG
