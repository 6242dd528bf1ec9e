"""Stored profiles, texts, samples, schemas, graphs and run snapshots as partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.session import new_path


def write_profile(prof: DataFrame, path: str) -> None:
    """Profile rows (dataset, table, column_name, ...) as JSON lines under dataset=/table= folders."""
    prof.write.mode("overwrite").partitionBy("dataset", "table").json(path)


def read_profile(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_column_text(texts: DataFrame, path: str) -> None:
    """(dataset, table, column_name, text) partitioned by dataset and table."""
    texts.write.mode("overwrite").partitionBy("dataset", "table").parquet(path)


def read_column_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def join_samples(samples: Column) -> Column:
    """Samples as one comma-joined text."""
    return F.array_join(samples, ", ")


def split_samples(line: Column) -> Column:
    """Samples out of a comma-joined text: trimmed, empties dropped."""
    return F.filter(F.transform(F.split(line, ","), lambda part: F.trim(part)), lambda s: s != "")


def write_samples(samples: DataFrame, path: str) -> None:
    """(dataset, table, column_name, sampled_values): one text per column, under dataset=/table=/column_name= folders, without analytics."""
    names = ["dataset", "table", "column_name"]
    lines = samples.select(*names, F.regexp_replace(join_samples(F.col("sampled_values")), "[\r\n]+", " ").alias("value"))
    lines.write.mode("overwrite").partitionBy(*names).text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, table, column_name, sampled_values) of written samples; names are texts whatever they look like."""
    shape = "value string, dataset string, table string, column_name string"
    rows = spark.read.schema(shape).text(path)
    return rows.select("dataset", "table", "column_name", split_samples(F.col("value")).alias("sampled_values"))


def write_graph_table(rows: DataFrame, kind: str, by: str, path: str) -> None:
    """Nodes (by label) or edges (by type), one folder per label or type, for bulk import. Ids are hexadecimal digests, which zstd
    brings to about half and Spark's default hardly shortens."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(f"{path}/{kind}")


def write_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], path: str) -> DataFrame:
    """Graph export with properties: every label and every type gets a folder of its own with its typed columns. Returns the manifest, which is
    written beside them: (kind, name, files, rows, checksum), read off what was written. One pass writes a label; the driver sees no rows."""
    manifest = None
    for kind, parts in (("nodes", nodes), ("edges", edges)):
        for name, df in parts.items():
            place = f"{path}/{kind}/{name}"
            df.write.mode("overwrite").parquet(place)
            back = df.sparkSession.read.parquet(place)
            facts = back.agg(F.count_distinct("_metadata.file_path").alias("files"), F.count(F.lit(1)).alias("rows"),
                             F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in back.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
            row = facts.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "files", "rows", "checksum")
            manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # one row per label and type
    return manifest.sparkSession.read.schema("kind string, name string, files bigint, rows bigint, checksum string").json(f"{path}/manifest")


def read_graph(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Nodes by label and edges by type of an export, as its manifest names them."""
    names = spark.read.schema("kind string, name string").json(f"{path}/manifest").collect()  # one row per label and type
    return tuple({r["name"]: spark.read.parquet(f"{path}/{kind}/{r['name']}") for r in names if r["kind"] == kind} for kind in ("nodes", "edges"))


def write_snapshot(rows: DataFrame, path: str, run_id: str, step: str) -> None:
    """State of one step of a run, under run_id=/step= folders; a repeated step replaces what it wrote before."""
    rows.withColumns({"run_id": F.lit(run_id), "step": F.lit(step)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "step").parquet(path)


def read_snapshot(spark: SparkSession, path: str, run_id: str, step: str) -> DataFrame:
    """One step of one run; only its folder is read."""
    rows = spark.read.parquet(path).filter((F.col("run_id") == run_id) & (F.col("step") == step))
    return rows.drop("run_id", "step")


def write_graph_schema(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Schema documents as JSON lines: nodes (type, attributes) by type, edges by type, source and target."""
    nodes.orderBy("type").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("type", "source", "target").write.mode("overwrite").json(f"{path}/edges")


SCHEMA_NODES = "type string, attributes array<string>"
SCHEMA_EDGES = "type string, source string, target string, attributes array<string>"


def read_graph_schema(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A written schema as rows of ``documents.read_graph_schemas``: (run_id, element, at, type, source, target, attr), one per
    attribute, with a NULL attribute where there is none; ``at`` tells nodes and edges apart."""
    def rows(part: str, shape: str, at) -> DataFrame:
        read = spark.read.schema(shape).json(f"{path}/{part}s")
        ends = [F.col(c) if c in read.columns else F.lit(None).cast("string").alias(c) for c in ("source", "target")]
        return read.select(F.lit(run_id).alias("run_id"), F.lit(part).alias("element"), at.alias("at"), "type", *ends, F.explode_outer("attributes").alias("attr"))
    return rows("node", SCHEMA_NODES, F.xxhash64("type")).unionByName(rows("edge", SCHEMA_EDGES, F.xxhash64("type", "source", "target")))


def roundtrip_text(texts: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    path = new_path(spark, "column_text")
    write_column_text(texts, path)
    return read_column_text(spark, path)
