"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import importlib

AREAS = ["quality", "packing", "warc", "topk", "prefix_bpe", "toxicity", "simhash", "shards", "secrets", "links", "personal", "variants", "centroids", "pipeline"]


def load():
    """Imports every area and returns the filled registry."""
    for area in AREAS:
        importlib.import_module(f"colonnade.llm.{area}")
    return importlib.import_module("colonnade.llm.registry")
