"""Registered queries and the SQL that checks them."""

from ripplepanel.catalog.registry import CATALOG, Context, load_all

__all__ = ["CATALOG", "Context", "load_all"]
