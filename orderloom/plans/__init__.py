"""Importing the package registers every query."""

from . import catalogue, models

__all__ = ["catalogue", "models"]
