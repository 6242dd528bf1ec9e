"""Registered queries and their reference SQL, by area."""

import importlib

AREAS = ["profile_queries", "text_queries", "graph_queries", "source_queries", "catalog_queries"]


def load():
    """Imports every area and returns the filled registry."""
    for area in AREAS:
        importlib.import_module(f"colonnade.plans.{area}")
    return importlib.import_module("colonnade.plans.registry")
