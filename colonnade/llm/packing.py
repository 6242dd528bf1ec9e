"""Tokenizing documents and packing them into sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import kept_by_worker, rank_within, uniform31
from colonnade.llm.registry import query, table
from colonnade.session import stage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1  # id after every document
ROOM = 2048
KEPT_WORDS = 450_000  # words, and parts of words, whose ids a worker keeps; all are dropped when there are more
# the pre-tokenizer's pattern, on lower-cased text (fixed values of the vocabulary file)
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Kept(dict):
    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = made = self.make(key)
        return made


class Coder:
    """Ids of whole texts by the tokenizer of a file, as little-endian unsigned 32-bit integers in bytes. The tokenizer drops white space
    and never looks across it, so a text is encoded word by word and each word once. The strings of special tokens give their ids, as in the
    tokenizer as it is loaded, or with `marks_as_text` those of plain text."""

    def __init__(self, path: str = VOCABULARY, marks_as_text: bool = False, kept: int = KEPT_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = marks_as_text
        self.model, self.parts = self.tokenizer.model, regex.compile(PARTS)
        # letters of which lower-casing and normalization are known: printable ASCII and the letters of Latin-1
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        # the pre-tokenizer writes bytes as letters: these stand for themselves, the others follow from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        self.letter = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        self.words, self.known = _Kept(self._word, kept), _Kept(self._part, kept)

    def _part(self, part: str) -> bytes:
        written = part if part.isascii() else "".join(map(self.letter.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.known.__getitem__, self.parts.findall(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


def coder(path: str = VOCABULARY, marks_as_text: bool = False, kept: int = KEPT_WORDS) -> Coder:
    return kept_by_worker(f"word_bpe {path} {marks_as_text} {kept}", lambda: Coder(path, marks_as_text, kept))


def pieces(docs: DataFrame, path: str = VOCABULARY, room: int = ROOM, ids: bool = True, key: str = "doc_id", text: str = "text",
           marks_as_text: bool = False, kept: int = KEPT_WORDS) -> DataFrame:
    """Every document as pieces of at most `room` ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (array of int).

    A document is its ids and END; null and empty texts are END alone. It is cut after every `room` ids, so all pieces but
    its last are full. Null keys and repeated rows are ordinary rows; further columns are ignored. A worker keeps the ids of `kept` words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = array("I", [END]).tobytes()
        for b in batches:
            out = []
            for doc, t in zip(b["doc_id"], b["text"]):
                data = coder(path, marks_as_text, kept).encode(t) + end
                for at in range(0, len(data), 4 * room):
                    part = data[at:at + 4 * room]
                    out.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4) + ((array("I", part).tolist(),) if ids else ()))
            done = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids)
            yield done.astype({"doc_id": "Int64"})
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else ""))


def patterns(histogram: dict[int, int], room: int = ROOM) -> list[tuple[list[tuple[int, int]], int]]:
    """Shortest pack first: lengths from the longest down, each put into the packs with the most room left, or into
    new ones where none has enough. All packs of one pattern move together, so the work depends on the number of
    different lengths (`room` at most) and not on that of documents. Returns patterns, as (length, times) pairs, with the number of packs."""
    packs: dict[int, list[list]] = defaultdict(list)  # room left: patterns and their counts
    done, most = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not packs[most]:
                most -= 1
            if most < length:  # new packs, each filled before the next is opened
                fit = room // length
                for times, count in ((fit, left // fit), (left % fit, 1)):
                    if times and count:
                        packs[room - times * length].append([[(length, times)], count])
                        most = max(most, room - times * length)
                left = 0
                continue
            made, count = packs[most][-1]
            if most >= 2 * length and left >= 2 * count and len(packs[most]) == 1:  # several rounds over the same packs at once
                below = max((r for r in range(most - 1, -1, -1) if packs[r]), default=0)
                times = min(left // count, max(1, (most - max(below, length)) // length))
            else:
                times = 1
            moved = min(count, left)
            if moved == count:
                packs[most].pop()
            else:
                packs[most][-1][1] -= moved
            packs[most - times * length].append([made + [(length, times)], moved])
            left -= times * moved
    for ready in packs.values():
        done += [(made, count) for made, count in ready]
    return sorted(done)


def slots(packed: Iterable[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, first sequence, sequences, first offset). The ranks of
    a length are dealt to patterns in turn; within a slot they go round its sequences, and each round starts where the last ended."""
    out, dealt, sequence = [], defaultdict(int), 0
    for made, count in packed:
        offset = 0
        for length, times in made:
            out.append((length, dealt[length], dealt[length] + times * count, sequence, count, offset))
            dealt[length] += times * count
            offset += times * length
        sequence += count
    return out


def pack(cut: DataFrame, room: int = ROOM, seed: int = 17) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset to pieces (doc_id, start, length and further columns).

    The driver gets the histogram of lengths, `room` rows at most, and places it; the table of slots that it sends back has a size
    bound by `room` as well, whatever the number of pieces. Pieces are ranked within their length in ranges of about
    sqrt(pieces) rows, so a length that a third of all pieces have is no task's burden, and their rank finds their slot."""
    held = stage(cut.withColumn("__hash", uniform31(F.lit(seed), F.col("doc_id"), F.col("start"), F.col("ids_crc32"))), "pieces")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = held.sparkSession
    places = spark.createDataFrame(slots(patterns(histogram, room)), "length long, __first long, __end long, __sequence long, __sequences long, __at long")
    ranked = rank_within(held, "length", "__hash", ["doc_id", "start", "ids_crc32", "doc_tokens"], sum(histogram.values()))
    turn = F.col("rank") - 1 - F.col("__first")
    found = ranked.join(F.broadcast(places), "length").where((F.col("rank") > F.col("__first")) & (F.col("rank") <= F.col("__end")))
    return found.select(*cut.columns, (F.col("__sequence") + turn % F.col("__sequences")).alias("sequence_id"),
                        (F.col("__at") + F.floor(turn / F.col("__sequences")) * F.col("length")).alias("offset"))


@query("op2_shortest_pack_first")
def op2_shortest_pack_first(spark: SparkSession, folder: str) -> DataFrame:
    """Packed pieces of all documents; tested against the tokenizer and by putting the sequences together again."""
    return pack(pieces(table(spark, folder, "documents"), ids=False))
