"""Spelling variants: words one letter apart, found with k-d trees over their letter counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table
from colonnade.session import stage

DIMS = 32  # a to z, and six for the other letters: words one edit apart differ by two at most in any merging of letters
LONG = 40  # words of so many letters and more share a tree
LEAF = 64  # words in a leaf of a cell's tree
KEPT = 400_000  # different words that a task counts before it hands them on
ASKED = 2048  # words that ask a tree at a time


def occurrences(docs: DataFrame, least: int, every: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the lower-cased runs of letters of all texts with their counts, several rows a word. Of a run whose crc32 with its document's
    id is divisible by `every`, the letter at that number goes; results under `least` letters are left out. A missing id counts as empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, held = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall, Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
            held.clear()
            return out
        for b in batches:
            for doc, t in zip(b["doc_id"], b["text"]):
                if t:
                    head = crc32(f"{doc}:".encode())
                    for w, n in Counter(find(t.encode().lower().decode())).items():  # bytes: only A to Z change
                        h = crc32(w.encode(), head)
                        if h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                        if len(w) >= least:
                            held[w] += n
                if len(held) >= KEPT:
                    yield flush()
        if held:
            yield flush()
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "word string, n long")


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of words in Latin-1, two at most, as 64 bits: bit d stands for one letter d and bit DIMS + d for a second.

    The bits that differ number as many as the L1 distance of such counts, which is never more than that of the full counts."""
    place = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])
    letters = place[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * DIMS + letters, minlength=len(words) * DIMS).reshape(-1, DIMS)
    return np.packbits(np.hstack([counts > 0, counts > 1]), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _ones(v: np.ndarray) -> np.ndarray:
    """How many vectors have each bit."""
    return np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _outside(v: np.ndarray, lo: np.uint64, hi: np.uint64) -> np.ndarray:
    """L1 distance of vectors to a box: what they lack of its least counts, and have beyond its largest."""
    return np.bitwise_count(lo & ~v) + np.bitwise_count(v & ~hi)


class Tree:
    """k-d tree over vectors: a node has the box of its vectors and is cut at the count that halves them best."""

    def __init__(self, v: np.ndarray):
        self.v, self.nodes = v, []  # box, children, and the rows of a leaf
        todo = [(np.arange(len(v)), None)]
        while todo:
            rows, parent = todo.pop()
            own = v[rows]
            lo, hi = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
            if parent is not None:
                self.nodes[parent][2].append(len(self.nodes))
            self.nodes.append((lo, hi, [], rows))
            if len(rows) > LEAF and lo != hi:
                bit = int(np.abs(2 * _ones(own) - len(rows)).argmin())
                has = (own >> np.uint64(bit) & np.uint64(1)).astype(bool)
                todo += [(part, len(self.nodes) - 1) for part in (rows[~has], rows[has])]

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of asked, row of the tree) within the radius, leaf by leaf; subtrees whose box is farther away are pruned."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            at, going = todo.pop()
            lo, hi, children, rows = self.nodes[at]
            going = going[_outside(asked[going], lo, hi) <= radius]
            if not len(going):
                continue
            if children:
                todo += [(c, going) for c in children]
                continue
            for i in range(0, len(rows), LEAF):  # equal vectors make leaves of any size
                some = rows[i:i + LEAF]
                q, m = np.nonzero(np.bitwise_count(asked[going, None] ^ self.v[None, some]) <= radius)
                if len(q):
                    yield going[q], some[m]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    other = np.flatnonzero(np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)[:len(a)])
    if len(a) == len(b):
        return len(other) == 1
    first = int(other[0]) if len(other) else len(a)
    return a[first:] == b[first + 1:]


class Spelled:
    """Words in Latin-1, with their letters as a matrix where all have the same length."""

    def __init__(self, words: list[bytes]):
        self.words, sizes = words, {len(w) for w in words}
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1) if len(sizes) == 1 else None


def edits(a: Spelled, b: Spelled, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) are one edit apart; the order of letters is compared for all pairs of the same lengths at once."""
    if a.letters is None or b.letters is None:
        return np.fromiter((one_edit(a.words[x], b.words[y]) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
    x, y = a.letters[i], b.letters[j]
    size = x.shape[1]
    if size == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    front = np.logical_and.accumulate(x == y[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


class Cells:
    """The upper levels of the trees, one per length of words: a cell is a leaf that holds a bounded number of words."""

    def __init__(self, sizes: dict[int, int]):
        self.root = {size: i for i, size in enumerate(sorted(sizes))}
        self.count = [sizes[s] for s in sorted(sizes)]
        self.cut: list[tuple[int, int] | None] = [None] * len(sizes)  # bit, and the child without it; the other one follows
        self.lo, self.hi = [np.uint64(0)] * len(sizes), [~np.uint64(0)] * len(sizes)
        self.whole: set[int] = set()  # leaves of equal vectors

    def split(self, leaf: int, bit: int, ones: int) -> None:
        self.cut[leaf] = (bit, len(self.cut))
        mask = np.uint64(1 << bit)
        self.cut += [None, None]
        self.count += [self.count[leaf] - ones, ones]
        self.lo += [self.lo[leaf], self.lo[leaf] | mask]
        self.hi += [self.hi[leaf] & ~mask, self.hi[leaf]]

    def home(self, v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Leaf of every word."""
        out = np.empty(len(v), np.int64)
        for size in np.unique(sizes).tolist():
            todo = [(self.root[size], np.flatnonzero(sizes == size))]
            while todo:
                at, rows = todo.pop()
                if self.cut[at] is None:
                    out[rows] = at
                elif len(rows):
                    bit, child = self.cut[at]
                    has = (v[rows] >> np.uint64(bit) & np.uint64(1)).astype(bool)
                    todo += [(child, rows[~has]), (child + 1, rows[has])]
        return out

    def reached(self, v: np.ndarray, rows: np.ndarray, size: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of v that have words within the radius there, if there are any) in the tree of a length."""
        todo = [(self.root[size], rows)] if size in self.root else []
        while todo:
            at, rows = todo.pop()
            rows = rows[_outside(v[rows], self.lo[at], self.hi[at]) <= radius]
            if not len(rows):
                continue
            if self.cut[at] is None:
                yield at, rows
            else:
                todo += [(self.cut[at][1], rows), (self.cut[at][1] + 1, rows)]


def _size(word: F.Column) -> F.Column:
    return F.least(F.length(word), F.lit(LONG))


def cells(words: DataFrame, limit: int) -> Cells:
    """Cuts every tree until no leaf has more than `limit` words: per level Spark counts the words of too large leaves by letter count and picks
    each leaf's most even cut. The driver gets one row per leaf; leaves number about twice the words over the limit."""
    made = Cells({r["size"]: r["n"] for r in words.groupBy(_size(F.col("word")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()})
    while True:
        over = {i for i, n in enumerate(made.count) if made.cut[i] is None and n > limit and i not in made.whole}
        if not over:
            return made

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                own = [w.encode("latin-1") for w in b["word"]]
                if own:
                    v = vectors(own)
                    home = made.home(v, np.minimum([len(w) for w in own], LONG))
                    for leaf in over.intersection(home.tolist()):
                        of = v[home == leaf]
                        held[leaf] = held.get(leaf, 0) + np.append(_ones(of), len(of))
            yield pd.DataFrame([(leaf, bit, int(n[bit]), int(n[-1])) for leaf, n in held.items() for bit in range(2 * DIMS)],
                               columns=["leaf", "bit", "ones", "rows"], dtype="int64")
        counts = words.select("word").mapInPandas(count, "leaf long, bit long, ones long, rows long").groupBy("leaf", "bit").agg(
            F.sum("ones").alias("ones"), F.sum("rows").alias("rows"))
        cuts = F.when((F.col("ones") > 0) & (F.col("ones") < F.col("rows")), F.struct(F.abs(2 * F.col("ones") - F.col("rows")).alias("uneven"), "bit", "ones"))
        for r in counts.groupBy("leaf").agg(F.min(cuts).alias("cut")).collect():
            if r["cut"] is None:
                made.whole.add(r["leaf"])
            else:
                made.split(r["leaf"], r["cut"]["bit"], r["cut"]["ones"])


def near_pairs(words: DataFrame, limit: int = 4000, most_cells: int = 1 << 14) -> DataFrame:
    """a, n_a, b, n_b for all ordered pairs of words (word, n; each word once, letters a to z and U+00C0 to U+00FF) that differ by exactly one letter.

    One edit moves the letter counts (two of a letter at most) by two at most in L1 if the lengths are equal, by one otherwise. So each word asks the tree of its own length
    with radius two and that of the next length with radius one; the upper levels send it only to the cells that its range meets,
    and each cell has its own tree. Cells hold `limit` words, more only beyond limit x most_cells words, which bounds the
    upper levels that go to the tasks. Words with equal counts cannot be cut apart: they are dealt to parts of `limit` words, and those who ask
    meet every part. Asking words stream past a cell's tree and are never held."""
    spark, total = words.sparkSession, words.count()
    limit = max(limit, total // most_cells)
    top = cells(words, limit)
    parts = {i: -(-top.count[i] // limit) for i in top.whole}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [w.encode("latin-1") for w in b["word"]]
            if not own:
                continue
            v, sizes = vectors(own), np.minimum([len(w) for w in own], LONG)
            home = top.home(v, sizes)
            part = np.array([crc32(w) % parts[h] if h in parts else 0 for w, h in zip(own, home.tolist())])
            out = [(home << 20 | part, np.zeros(len(b), np.int64), np.arange(len(b)))]
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                asks = [(1, size, 2)] + [(2, size + 1, 1)] * (size < LONG)
                out += [(np.full(len(r), leaf << 20 | p), np.full(len(r), role), r) for role, tree, radius in asks
                        for leaf, r in top.reached(v, rows, tree, radius) for p in range(parts.get(leaf, 1))]
            cell, asks, row = (np.concatenate(x) for x in zip(*out))
            yield pd.DataFrame({"cell": cell, "asks": asks, "word": b["word"].to_numpy()[row], "n": b["n"].to_numpy()[row]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, counts, tree, members, spelled = None, [], [], None, [], None
        for b in batches:
            cell, asks, names, n = (b[c].to_numpy() for c in ("cell", "asks", "word", "n"))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(b)]
            found = []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if cell[i] != at:
                    at, held, counts, tree = cell[i], [], [], None
                if asks[i] == 0:
                    held += [w.encode("latin-1") for w in names[i:j]]
                    counts.append(n[i:j])
                    continue
                if tree is None and held:
                    tree, members, spelled = Tree(vectors(held)), np.concatenate(counts), Spelled(held)
                for k in range(i, j if held else i, ASKED):
                    own = Spelled([w.encode("latin-1") for w in names[k:min(j, k + ASKED)]])
                    for q, m in tree.within(vectors(own.words), 3 - int(asks[i])):
                        near = edits(own, spelled, q, m)
                        if near.any():
                            q, m = q[near], m[near]
                            found.append((names[k + q], n[k + q], [held[x].decode("latin-1") for x in m.tolist()], members[m]))
                            if asks[i] == 2:
                                found.append((found[-1][2], found[-1][3], found[-1][0], found[-1][1]))
            if found:
                yield pd.DataFrame({c: np.concatenate([np.asarray(f[x], kind) for f in found]) for x, (c, kind) in enumerate(
                    (("a", object), ("n_a", np.int64), ("b", object), ("n_b", np.int64)))})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(c is None for c in top.cut) // 8)
    dealt = words.select("word", "n").mapInPandas(deal, "cell long, asks long, word string, n long")
    return dealt.repartition(tasks, "cell").sortWithinPartitions("cell", "asks").mapInPandas(search, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms (word, form) lead. Every round follows all chains twice as far, so few rounds are enough."""
    now = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, least: int = 6, least_n: int = 5, times: int = 5, every: int = 199, key: str = "doc_id", text: str = "text",
             limit: int = 4000) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with at least `least` letters and `least_n` occurrences.

    form is the near word (one letter inserted, deleted or replaced) with most occurrences, ties to the smallest in code-point order,
    if it has at least `times` as many as the word; root is where forms lead in the end, the word itself without one. Forms grow in
    occurrences, so chains end. Null and empty texts have no words; a null id counts as empty; repeated rows count as often as they are; an empty
    table gives no rows; further columns are ignored. Runs of any length are words of their own."""
    counted = occurrences(docs, least, every, key, text).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    words = stage(counted, "words")
    found = near_pairs(words, limit).groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"), F.first("n_a").alias("n"))
    enough = -F.col("best.less") >= times * F.col("n")
    near = stage(found.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    return (words.join(near, "word", "left").join(roots(near.where("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))


@query("op12_letter_count_trees")
def op12_letter_count_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Variants among the words of all documents. DuckDB has no CRC-32, so there is no SQL."""
    return variants(table(spark, folder, "documents"))
