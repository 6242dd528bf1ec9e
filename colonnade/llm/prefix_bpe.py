"""Byte-level BPE by prefix dynamic programming."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import kept_by_worker
from colonnade.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
KEPT_WORDS = 600_000  # words whose ids a worker keeps; all are dropped when there are more


TOGETHER = 8_000_000  # characters of texts whose new words are looked at together


class Vocabulary:
    """Tokens with their ranks (= ids), and which tokens may stand next to each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach = [0] * 256  # longest token that ends in a byte
        for t in ranks:
            self.reach[t[-1]] = max(self.reach[t[-1]], len(t))
        self.none = 1 << 40  # rank of what is no token
        self.known: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.sound = {t: i for t, i in ranks.items() if self.alone(i)}

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The defining rule, on short texts only: join the neighbours of lowest rank, leftmost first, while there are any
        and more than `least` parts."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(a + b, self.none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == self.none:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge, the last of its own encoding, makes a token; None for a byte and for tokens merges don't lead to."""
        if token not in self.split:
            parts = self.merged(self.tokens[token], 2)
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def follows(self, before: int, token: int) -> bool:
        """Whether `token` can come after `before`: no merge crosses their border. A sequence of tokens is the encoding of its bytes
        exactly if this holds for all neighbours, since merges inside two tokens run as they do in the whole.

        Both tokens are taken apart in the reverse order of their merges. At each step the parts at the border must not have
        a merge that would have come first: one of lower rank than the merge just undone, or of the same rank further left."""
        pair = before << 32 | token
        known = self.known.get(pair)
        if known is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            known = self.known[pair] = self._follows(before, token)
        return known

    def _follows(self, left: int, right: int) -> bool:
        ranks, tokens, undone = self.ranks, self.tokens, self.none
        while ranks.get(tokens[left] + tokens[right], self.none) >= undone:
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):  # the left token's merge came last, and before the border's if equal
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]
        return False


class Prefixes:
    """The encoding of every prefix of a byte string, each stored as its one valid last token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, ends: range) -> Iterator[int]:
        """Adds the last token of each prefix: the one token that ends there and may follow the encoding before it."""
        v, data, last = self.vocabulary, self.data, self.last
        sound, reach, known, follows = v.sound.get, v.reach, v.known.get, v.follows
        for end in ends:
            for size in range(min(end, reach[data[end - 1]]), 0, -1):
                token = sound(data[end - size:end])
                if token is not None:
                    if end == size:
                        break
                    before = last[end - size]
                    fits = known(before << 32 | token)
                    if fits or fits is None and follows(before, token):
                        break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
            last.append(token)
            yield end

    def append(self, data: bytes) -> None:
        """Exact encodings of the longer text: only the new prefixes are computed."""
        start, self.data = len(self.data), self.data + data
        for _ in self._extend(range(start + 1, len(self.data) + 1)):
            pass

    def become(self, data: bytes) -> None:
        """Goes over to another text, keeping the prefixes that both share."""
        shared = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            shared += 1
        self.data = self.data[:shared]
        del self.last[shared + 1:]
        self.append(data[shared:])

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Replaces bytes [start, end). Prefixes before stay; after the edit, once as many last tokens in a row as the longest token has
        bytes are what they were, all later ones are too. Returns the number of prefixes computed."""
        old, tail, shift = self.last, self.data[end:], len(data) - (end - start)
        self.data, self.last = self.data[:start] + data + tail, self.last[:start + 1]
        same = 0
        for at in self._extend(range(start + 1, len(self.data) + 1)):
            was = at - shift
            same = same + 1 if was > end and old[was] == self.last[at] else 0
            if same >= self.vocabulary.longest:
                self.last += old[was + 1:]
                return at - start
        return len(self.data) - start

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first `end` bytes (all by default), read off from the end."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class _Words(dict):
    """Ids of words as bytes, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids = self.make(word)
        return ids


class Coder:
    """Whole texts to ids and back. Ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        import regex

        self.vocabulary = Vocabulary.read(path)
        self.pattern = regex.compile(pattern)
        self.state = Prefixes(self.vocabulary)
        self.pieces = _Words(self._piece)
        self.first, self.later = _Words(self._word), _Words(lambda word: self._word(word, " "))
        self.table = [self.vocabulary.tokens.get(i, b"") for i in range(max(self.vocabulary.tokens) + 1)]

    def _word(self, word: str, before: str = "") -> bytes | None:
        """Ids of a word between two spaces; None if white space stands next to one, since then pieces depend on more than one word."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(before + word)))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)  # a piece that is a token is that token, even if merges don't lead to it
        if whole is not None:
            return array("I", (whole,)).tobytes()
        self.state.become(data)
        return array("I", self.state.ids()).tobytes()

    def learn(self, texts: Iterable[str | None]) -> None:
        """Encodes the new words of some texts in sorted order, so that each starts from the prefixes it shares with the one before."""
        first, later, pieces = set(), set(), set()
        for text in texts:
            if text:
                head, *rest = text.split(" ")
                first.add(head)
                later.update(rest)
        first.difference_update(self.first)
        later.difference_update(self.later)
        for known, words, before in ((self.first, first, ""), (self.later, later, " ")):
            if len(known) + len(words) > KEPT_WORDS:
                known.clear()
            for word in words:
                pieces.update(self.pattern.findall(before + word))
        pieces.difference_update(self.pieces)
        if len(self.pieces) + len(pieces) > KEPT_WORDS:
            self.pieces.clear()
        for piece in sorted(pieces):
            self.pieces[piece] = self._piece(piece)

    def encode(self, text: str | None) -> bytes:
        """Each match of the pattern by itself. The pattern ends every match before a space that stands alone, so an even text is
        encoded word by word, each with the space before it."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        if (start := self.first[head]) is not None:
            try:
                return start + b"".join(map(self.later.__getitem__, rest))
            except TypeError:  # a None among them
                pass
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


    def encoded(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Encodings of many texts, a bounded number of characters at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                self.learn(held)
                yield from map(self.encode, held)
                held, size = [], 0
        self.learn(held)
        yield from map(self.encode, held)


def coder(path: str = VOCABULARY) -> Coder:
    return kept_by_worker(f"prefix_bpe {path}", lambda: Coder(path))


def encode(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row. Null and empty texts have no ids; null keys, repeated rows and rows of any length
    are encoded like others; an empty table gives no rows; further columns are ignored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.frombuffer(i, "<u4").astype(np.int32) for i in coder(path).encoded(b["text"])]})
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text (binary) of rows with doc_id and ids; null ids give no bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [b"" if i is None else coder(path).decode(np.asarray(i, "<u4").tobytes()) for i in b["ids"]]})
    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encode and decode in one task, without shipping the ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ids in coder(path).encoded(b["text"]):
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder(path).decode(ids)).hexdigest()))
            done = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            done.insert(0, "doc_id", b["doc_id"].array)
            yield done
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op5_prefix_bpe")
def op5_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token digests of all documents; tested against tiktoken."""
    return digests(table(spark, folder, "documents"))
