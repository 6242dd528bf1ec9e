"""Schema, synonym and metadata documents as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDECAR = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("date_created", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("columns", T.MapType(T.StringType(), T.StructType([
        T.StructField("description", T.StringType()), T.StructField("type", T.StringType())]))),
])
# Section names of a synonym document.
SYNONYM_SECTIONS = {"node_synonyms": "node", "relation_synonyms": "relation", "property_synonyms": "property",
                    "invertible_relations": "invertible"}


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(table, language, column_name, description, type) from sidecar documents, one row per described column."""
    docs = spark.read.schema(SIDECAR).option("multiLine", True).option("recursiveFileLookup", "true").json(path)
    named = docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(?:\.json)?(?:/[^/]*)?$", 1).alias("table"), "language", "columns")
    return named.select("table", "language", F.explode("columns").alias("column_name", "d")).select(
        "table", "language", "column_name", "d.description", "d.type")


def _load(content: bytes):
    import yaml
    return yaml.load(content, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}  # JSON is read as YAML


def _names(item: dict) -> list[str]:
    """Attribute names of a node or edge: plain texts, or the keys of ``name: type`` entries."""
    out = []
    for entry in item.get("attributes") or item.get("properties") or []:
        out += [str(k) for k in entry] if isinstance(entry, dict) else [str(entry)]
    return out


def _schema_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for run, content in zip(batch["run_id"], batch["content"]):
            doc = _load(content)
            for i, node in enumerate(doc.get("nodes") or []):
                rows += [(run, "node", i, str(node["type"]), None, None, a) for a in _names(node) or [None]]
            for i, edge in enumerate(doc.get("edges") or []):
                rows += [(run, "edge", i, str(edge["type"]), str(edge["source"]), str(edge["target"]), a) for a in _names(edge) or [None]]
        yield pd.DataFrame(rows, columns=["run_id", "element", "at", "type", "source", "target", "attr"])


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", pattern, 1).alias("run_id"), "content")


def read_graph_schemas(spark: SparkSession, path: str, run_pattern: str = r"/([^/]+?)(?:\.[a-z]+)?$") -> DataFrame:
    """One row per node or edge attribute of YAML or JSON schema documents (each a small file)."""
    return _documents(spark, path, run_pattern).mapInPandas(
        _schema_rows, "run_id string, element string, at int, type string, source string, target string, attr string")


def _synonym_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for run, content in zip(batch["run_id"], batch["content"]):
            doc = _load(content)
            for section, kind in SYNONYM_SECTIONS.items():
                entries = doc.get(section) or {}
                if isinstance(entries, list):
                    entries = {e: [] for e in entries}
                for pos, (name, words) in enumerate(entries.items()):
                    rows += [(run, kind, pos, str(name), i, None if w is None else str(w)) for i, w in enumerate(words or [None])]
        yield pd.DataFrame(rows, columns=["dataset", "kind", "pos", "canonical", "syn_pos", "synonym"])


def read_synonyms(spark: SparkSession, path: str, dataset_pattern: str = r"/([^/]+?)(?:\.[a-z]+)?$") -> DataFrame:
    """(dataset, kind, pos, canonical, syn_pos, synonym) with the order of the documents kept."""
    return _documents(spark, path, dataset_pattern).mapInPandas(
        _synonym_rows, "dataset string, kind string, pos int, canonical string, syn_pos int, synonym string")
