"""Near-duplicates by SimHash fingerprints and the exact Jaccard similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm import simhash
from colonnade.llm.common import keep_nothing
from colonnade.llm.simhash import SEED, components
from colonnade.session import Workspace

TOGETHER = 1 << 18  # shingles of texts held at a time, and pairs from which on they are taken in turns
GROUP = 256  # pairs of one set in a group
TURNS = 4  # parts of the shingles, and of the pairs, that are worked on one after another
RADIUS = 2  # bits by which fingerprints of candidates differ
BATCH = 1000  # rows that go to Python at a time


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, signed. Words and short texts as in `simhash.fingerprint`; a text without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    parts = {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)).view(np.int64))


def kept(n: int) -> int:
    """How many of n hashes go along: the first fifth and one, by which similar sets meet, and some more that stand in for very common ones."""
    return min(n, n // 5 + 1 + n // 20 + 8)


def _of_rows(docs: DataFrame, width: int, key: str, text: str, whole: bool) -> DataFrame:
    """doc_id, `name` of the set of shingles, its fingerprint, its size n, and its shingles: all, or the first `kept(n)`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        def table(ids: pd.Series, sets: list[np.ndarray]) -> pd.DataFrame:
            names = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            return pd.DataFrame({"doc_id": ids.astype("Int64"), "name": names, "fp": [simhash.majority(s) for s in sets], "n": [len(s) for s in sets],
                                 "parts": [s if whole else s[:kept(len(s))] for s in sets]}, index=ids.index)
        keep_nothing()
        for b in batches:
            first, sets, size = 0, [], 0
            for i, t in enumerate(b["text"]):
                sets.append(shingles(t, width))
                size += len(sets[-1])
                if size >= TOGETHER or i + 1 == len(b):
                    yield table(b["doc_id"].iloc[first:i + 1], sets)
                    first, sets, size = i + 1, [], 0
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, name long, fp long, n long, parts array<long>")


def _positions(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def possible(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """Whether two sets, of which only the smallest hashes are given, can have a similarity of 0.8. Up to the smaller of the last hashes both sets are
    known; a similarity of 0.8 leaves a ninth of n + n as differences, so more of them there rule it out."""
    last = min(a[-1], b[-1])
    a, b = a[:np.searchsorted(a, last, "right")], b[:np.searchsorted(b, last, "right")]
    return 9 * (len(a) + len(b) - 2 * _positions(a, b)) <= n_a + n_b


def similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """A similarity of 0.8 or more of whole sets, in whole numbers: 9 x common >= 4 x (n + n)."""
    return 9 * _positions(a, b) >= 4 * (n_a + n_b)


def _passing(pairs: DataFrame, sets: DataFrame, test: Callable[[np.ndarray, int, np.ndarray, int], bool]) -> DataFrame:
    """The distinct pairs a, b whose sets (id, n, parts) pass the test. Pairs are grouped by a, at most about `GROUP` in a group: its set comes once for the
    group, that of b once for the pair; tasks hold the first and let the others pass."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    own = [F.col("n"), F.col("parts")]
    centers = groups.join(sets, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("at"), F.lit(None).cast("long").alias("b"), *own)
    members = pairs.join(groups, "a").join(sets, F.col("b") == F.col("id")).select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("at"), "b", *own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        of, n_a, center = None, 0, None
        for t in batches:
            found = []
            for a, b, n, parts in zip(t["a"], t["b"], t["n"], t["parts"]):
                if pd.isna(b):
                    of, n_a, center = a, n, parts
                elif of == a and test(center, n_a, parts, n):
                    found.append((a, int(b)))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return centers.unionByName(members).repartition("a", "at").sortWithinPartitions("a", "at", F.col("b").asc_nulls_first()).mapInPandas(run, "a long, b long").distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs a < b of different parts that share a key and whose sizes allow a similarity of 0.8."""
    a, b = [members.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "part")]) for s in "ab"]
    fits = (F.col("id_a") < F.col("id_b")) & (F.col("part_a") != F.col("part_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    return a.join(b, "key").where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Candidates a < b of sets (id, fp, n): the first set of a fingerprint with all others that have it, and with those of the fingerprints that the
    BK-trees link; at most one pair a set and shard. Sizes must allow a similarity of 0.8."""
    firsts = sets.groupBy("fp").agg(F.min("id").alias("first"))
    found = simhash.links(firsts.select("fp"), RADIUS).distinct()
    ends = [firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab"]
    pairs = found.join(ends[0], "a").join(ends[1], "b").select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    pairs = pairs.unionByName(sets.join(firsts, "fp").select(F.col("first").alias("x"), F.col("id").alias("y"))).where("x <> y")
    sizes = [sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in "xy"]
    fits = 5 * F.least("n_x", "n_y") >= 4 * F.greatest("n_x", "n_y")
    return pairs.join(sizes[0], "x").join(sizes[1], "y").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _several(rows: DataFrame, of: str) -> DataFrame:
    """Rows of the keys under which `of` takes more than one value, with its smallest value `least` and the number `m` of the key's rows. Keys are
    counted with partial sums and joined back, so that a very common key can be split."""
    facts = rows.groupBy("key").agg(F.min(of).alias("least"), F.max(of).alias("__most"), F.count(F.lit(1)).alias("m")).where("least < __most").drop("__most")
    return rows.join(facts, "key")


def near_duplicates(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text", limit: int = 64) -> DataFrame:
    """doc_id and component_id of every row of docs: rows are linked when the sets of their `width`-word shingles have a Jaccard similarity of
    0.8 or more, and component_id is the smallest doc_id that links reach.

    SimHash fingerprints of the sets meet in BK-trees, and what these find is compared first, which links light copies by one pair a member. A few
    bits do not reach all pairs, so the shingles themselves find the others.
    No pair is lost: sets that are that similar have a shingle in common among the first n // 5 + 1 of each, in any order of all shingles.
    Equal sets count once. In the order of the hashes, the sets under each shingle are compared with the smallest first, which
    links large groups by one pair a member. For the pairs that are not yet linked the order is another: shingles under which
    more than `limit` sets of several groups meet come last, so that common passages make no pairs; a set goes on to its next hashes instead, and
    the few sets that mostly consist of such shingles are taken whole. Pairs are first held against the known shingles,
    which rules out most of those that only share a passage; whole sets are made for the sets that are left. Written
    tables are dropped when the last table that needs them is written.
    Null and empty texts are equal sets; rows without doc_id take their component's smallest; further columns are ignored."""
    with Workspace(docs.sparkSession, "shingles", {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}) as space:
        return _linked(space, docs, width, key, text, limit)


def _linked(space: Workspace, docs: DataFrame, width: int, key: str, text: str, limit: int) -> DataFrame:
    stage, drop = space.stage, space.drop
    marked = stage(_of_rows(docs, width, key, text, False), "marked")
    sets = stage(marked.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("parts").alias("parts"))
                 .withColumn("id", F.monotonically_increasing_id()), "sets")

    def whole(ids: DataFrame) -> DataFrame:
        """Whole sets of ids. Of repeated doc_ids all rows are read, those with other texts fall out by their name."""
        chosen = stage(sets.join(ids, "id").select("id", "name", "first_id"), "chosen")
        own = docs.join(chosen.select("first_id").distinct(), F.col(f"`{key}`").cast("long").eqNullSafe(F.col("first_id")), "left_semi")
        out = stage(_of_rows(own, width, key, text, True).join(chosen.select("id", "name"), "name").select("id", "n", "parts"), "whole")
        drop(chosen)
        return out

    def confirmed(pairs: DataFrame) -> DataFrame:
        # the sets of the pairs go through the shuffle, so pairs are taken in turns
        pairs, out = stage(pairs, "pairs"), []
        turns = min(TURNS, 1 + pairs.count() // TOGETHER)
        for i in range(turns):
            near = stage(_passing(pairs.where(F.pmod(F.xxhash64("a"), F.lit(turns)) == i), sets.select("id", "n", "parts"), possible), "near")
            of = whole(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
            out.append(stage(_passing(near, of, similar), "links"))
            drop(near, of)
        drop(pairs)
        return reduce(DataFrame.unionByName, out)
    light = confirmed(fingerprint_pairs(sets.where("n > 0").select("id", "fp", "n")))
    linked = stage(components(light).select(F.col("node").alias("id"), F.col("root").alias("part")), "parts")
    # the shingles are taken in turns, so that only one turn's rows lie in shuffle files at a time
    rows = sets.select("id", "n", F.posexplode("parts").alias("at", "key"))
    turns = [stage(_several(rows.where(F.pmod("key", F.lit(TURNS)) == i).withColumn("own", F.col("id")), "own").drop("own"), "met") for i in range(TURNS)]
    met = reduce(DataFrame.unionByName, turns)
    # pairs with the first under each shingle, if their sizes allow a similarity of 0.8
    firsts = sets.select(F.col("id").alias("least"), F.col("n").alias("least_n"))
    fits = 5 * F.least("n", "least_n") >= 4 * F.greatest("n", "least_n")
    some = met.where((F.col("id") != F.col("least")) & (F.col("at") <= F.floor(F.col("n") / 5))).groupBy("least", "id").agg(F.first("n").alias("n"))
    sides = [linked.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part")) for c in "ab"]
    open_pairs = some.join(firsts, "least").where(fits).select(F.col("least").alias("a"), F.col("id").alias("b")).join(sides[0], "a", "left").join(sides[1], "b", "left")
    links = light.unionByName(confirmed(open_pairs.where("coalesce(a_part <> b_part, true)").select("a", "b")))
    parts = stage(components(links).select(F.col("node").alias("id"), F.col("root").alias("part")), "parts")
    known = met.drop("least", "m").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    before = F.sum(F.col("common").cast("long")).over(Window.partitionBy("id").orderBy("at"))
    left = stage(_several(known, "part").withColumn("common", F.col("m") > limit).withColumn("before", before), "left")
    drop(*turns)
    pairs = _pairs(left.where("NOT common AND at - before <= floor(n / 5)"))
    # sets with too few shingles of their own among the kept ones
    common = left.where("common").select("key").distinct()
    poor = stage(left.where("common").groupBy("id", "n", "part").agg(F.count(F.lit(1)).alias("c"))
                 .where("least(n, floor(n / 5) + floor(n / 20) + 9) - c < floor(n / 5) + 1").select("id", "part"), "poor")
    if poor.limit(1).count():
        of = whole(poor.select("id"))
        every = of.join(poor, "id").select("id", "n", "part", F.explode("parts").alias("key")).join(common.withColumn("common", F.lit(True)), "key", "left")
        turn = F.row_number().over(Window.partitionBy("id").orderBy(F.col("common").isNotNull(), "key"))
        own = stage(every.withColumn("turn", turn).where("turn <= floor(n / 5) + 1"), "poor")
        fresh = own.where("common IS NULL").select("key").distinct()
        others = sets.select("id", "n", F.explode("parts").alias("key")).join(fresh, "key", "left_semi").join(parts, "id", "left").join(poor.select("id"), "id", "left_anti")
        rows = own.select("key", "id", "n", "part").unionByName(others.select("key", "id", "n", F.coalesce("part", "id").alias("part")))
        pairs = pairs.unionByName(_pairs(rows)).distinct()
        pairs = stage(pairs, "pairs")
        drop(of, own)
    more = confirmed(pairs)
    drop(left, parts, poor, linked)
    roots = components(links.unionByName(more))
    rooted = stage(sets.join(roots, F.col("id") == F.col("node"), "left").select("name", "first_id", F.coalesce("root", "id").alias("root")), "roots")
    drop(sets)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(rooted.join(least, "root").select("name", "component_id"), "named")
    drop(rooted)
    return marked.join(named, "name").select("doc_id", "component_id")
