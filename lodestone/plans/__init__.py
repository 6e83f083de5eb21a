"""Queries over the given tables, each with its SQL twin."""

from . import assets, catalog  # noqa: F401
