"""Near-duplicates by SimHash fingerprints, found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table
from colonnade.session import stage

BITS, SEED, CHUNK = 64, 42, 1 << 18  # CHUNK: shingles counted at a time


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer. Words are runs without ASCII white space, A-Z
    lower-cased; a text with fewer words than `width` is one shingle, one without words has fingerprint zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < width else zip(*(words[i:] for i in range(width)))
    count = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(partial(xxh64_intdigest, seed=SEED), map(b" ".join, shingles)), np.uint64, count))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; zero without hashes."""
    count = len(hashes)
    if not count:
        return 0
    ones = sum(np.unpackbits(hashes[i:i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
               for i in range(0, count, CHUNK))
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t, width) for t in b["text"]]})
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


class Tree:
    """BK-tree over distinct 64-bit values: every child hangs on the edge named by its Hamming distance to its parent."""

    def __init__(self, values: np.ndarray):
        """The first value of a set is its node; the others go down by their distance, each set in one step."""
        self.values, self.children = values, [{} for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            node, rest = todo[-1][0], todo.pop()[1:]
            if len(rest):
                away = np.bitwise_count(values[rest] ^ values[node])
                order = np.argsort(away, kind="stable")
                edges, first = np.unique(away[order], return_index=True)
                for edge, part in zip(edges.tolist(), np.split(rest[order], first[1:])):
                    self.children[node][edge] = int(part[0])
                    todo.append(part)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, queries within `radius` of it) for all nodes that queries reach. All queries go down together; one
        follows an edge only if it is within `radius` of its distance to the node (triangle inequality)."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, asked = todo.pop()
            away = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            near = asked[away <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asked[np.abs(away - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def links_of(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its group) for values that are linked within the bucket, as indices."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for node, near in Tree(values).within(values, radius):
        a = find(node)
        for q in near.tolist():
            b = find(q)
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
    return [(i, find(i)) for i in range(len(values)) if find(i) != i]


def _parts(bits: list[int], radius: int) -> list[int]:
    """Masks of two of `radius + 2` blocks of the given bits: values within `radius` agree on at least one mask."""
    blocks = [reduce(lambda m, b: m | 1 << b, block.tolist(), 0) for block in np.array_split(np.array(bits), radius + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """One row per mask: its number `k`, the masked bits `key`, and fp."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("p")
    return rows.select("fp", pairs).select("p.*", "fp")


def _searched(buckets: DataFrame, radius: int) -> DataFrame:
    """Links a, b inside the buckets (k, key). Tasks walk sorted rows and hold one bucket at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def bucket(parts: list[np.ndarray]) -> pd.DataFrame:
            values = np.unique(np.concatenate(parts))
            found = np.array(links_of(values.view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})
        held, at = [], None
        for b in batches:
            out, names, fp = [], b[["k", "key"]].to_numpy(), b["fp"].to_numpy()
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                name = tuple(names[i])
                if name != at and held:
                    out.append(bucket(held))
                    held = []
                at = name
                held.append(fp[i:j])
            if out:
                yield pd.concat(out)
        if held:
            yield bucket(held)
    return buckets.select("k", "key", "fp").repartition("k", "key").sortWithinPartitions("k", "key", "fp").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, radius: int = 2, limit: int = 4096) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) whose connected components are those of all pairs within `radius`.

    Fingerprints are dealt to shards by the bits of two of radius + 2 blocks: two of them within the radius agree on two blocks, so
    they meet in at least one shard. Each shard has its own BK-tree, and its fingerprints follow only the edges
    within the radius. Shards with more than `limit` members are dealt once more by two blocks of their other bits, which
    leaves 16 free bits for radius 2: no tree ever has more than 65,536 nodes. A shard gives one link per member, not its pairs."""
    masks = _parts(list(range(BITS)), radius)
    keyed = _keyed(fps, masks)
    sizes = stage(keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    sized = stage(keyed.join(sizes, ["k", "key"]), "shards")
    small = sized.where(F.col("n") <= limit)
    again = []
    for k, m in enumerate(masks):
        inner = _parts([b for b in range(BITS) if not m >> b & 1], radius)
        again.append(_keyed(sized.where((F.col("k") == k) & (F.col("n") > limit)).select("fp"), [m | i for i in inner])
                     .withColumn("k", F.col("k") + len(masks) + k * len(inner)))
    large = reduce(DataFrame.unionByName, again)
    return _searched(small.select("k", "key", "fp").unionByName(large.select("k", "key", "fp")), radius)


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its connected component) for every node of the edges a, b.

    Rounds of large and small stars until nothing changes. Each half is a minimum per node, with partial minima before the shuffle,
    and a join with it; no list of neighbours is ever gathered. Each round is a table in the shared folder."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs: rows are linked when their fingerprints differ in at
    most `radius` bits, and component_id is the smallest doc_id that links reach.

    Equal fingerprints count once, so copies cost one row each. Null and empty texts have fingerprint zero and are linked
    like others; rows without doc_id take their component's smallest doc_id, null where it has none; repeated rows come
    out as often as they are; an empty table gives no rows; further columns are ignored."""
    marked = stage(fingerprints(docs, width, key, text), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = stage(components(links(distinct.select("fp"), radius)), "roots")
    rooted = stage(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    least = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "roots")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_simhash_bktree")
def op7_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash components of all documents. DuckDB has no XXH64, so there is no SQL."""
    return near_duplicates(table(spark, folder, "documents"))
