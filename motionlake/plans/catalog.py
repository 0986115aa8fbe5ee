"""Importing this module fills the registry."""

from . import component_queries, jump_queries, source_queries, sprint_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
