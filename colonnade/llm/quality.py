"""Quality rules: text statistics and repetition by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
TOGETHER = 200_000  # words of texts that share one suffix array; a longer text has its own


@dataclass(frozen=True)
class Limits:
    """Repeats of fewer than `least` words don't count. A text is rejected if repeats cover more than `covered` of its words, or
    one repeat has more than `longest` words."""
    least: int = 10
    covered: float = 0.4
    longest: int = 50


@dataclass
class SuffixArray:
    """Of several texts at once: `texts[i]` numbers the text of word i, and no repeat goes across two texts."""
    words: np.ndarray
    texts: np.ndarray

    def __post_init__(self):
        """Prefix doubling. A suffix's rank is the place of the first suffix that agrees with it so far; each round looks only at
        suffixes that share their rank, twice as many words deep, and keeps its ranks for the common prefixes."""
        n, order = len(self.words), np.lexsort((self.words, self.texts))
        new = np.r_[True, (self.words[order][1:] != self.words[order][:-1]) | (self.texts[order][1:] != self.texts[order][:-1])][:n]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, depth = [rank], 1
        ends = np.searchsorted(self.texts, self.texts, side="right")  # texts are numbered upwards
        while True:
            shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(shared):
                break
            after = shared + depth
            inside = after < ends[shared]
            second = np.where(inside, rank[np.where(inside, after, 0)], -1)
            by = np.lexsort((second, rank[shared]))
            at, first, second = shared[by], rank[shared][by], second[by]
            place = np.arange(len(at))
            group = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], place, 0))
            part = np.maximum.accumulate(np.where(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])], place, 0))
            rank = rank.copy()
            rank[at] = first + part - group
            self.levels.append(rank)
            depth *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.ends = ends

    def common(self) -> np.ndarray:
        """lcp[i]: words that the suffixes at places i - 1 and i of the array share, from the kept ranks, halving the step."""
        lcp, first = np.zeros(len(self.order) + 1, np.int64), self.levels[0]
        i = np.flatnonzero(first[self.order[1:]] == first[self.order[:-1]]) + 1
        a, b, size = self.order[i - 1], self.order[i], np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            x, y, rank = a + size, b + size, self.levels[level]
            inside = (x < self.ends[a]) & (y < self.ends[b])
            same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            size[same] += 1 << level
        lcp[i] = size
        return lcp

    def maximal(self, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        """(length, first place, last place) of the maximal repeats of `least` words or more: the intervals of the array
        whose suffixes share exactly `length` words and don't all follow the same word."""
        before = np.where((self.order > 0) & (self.texts[self.order - 1] == self.texts[self.order]), self.words[self.order - 1], -1 - self.order)
        differs = np.concatenate(([0], np.cumsum(np.r_[False, before[1:] != before[:-1]][:len(before)])))
        out: list[tuple[int, int, int]] = []
        places = np.flatnonzero(lcp >= least)
        stack: list[tuple[int, int]] = []  # (length, first place) of open intervals

        def close(last: int, down_to: int) -> int:
            start = last
            while stack and stack[-1][0] > down_to:
                size, start = stack.pop()
                if differs[last + 1] > differs[start + 1]:
                    out.append((size, start, last))
            return start
        previous = -2
        for place, size in zip(places.tolist(), lcp[places].tolist()):
            if place != previous + 1 and stack:
                close(previous, 0)
            start = close(place - 1, size) if stack else place - 1
            if not stack or stack[-1][0] < size:
                stack.append((size, start))
            previous = place
        if stack:
            close(previous, 0)
        return out


def measure(texts: list[str | None], limits: Limits = Limits()) -> pd.DataFrame:
    """Statistics and verdict of each text; the repeats of all of them come from one suffix array."""
    number: dict[bytes, int] = {}
    words, base = [], []
    for text in texts:
        text = text or ""
        data = text.encode("utf-8", "replace")
        found = data.split()  # splits at SPACES exactly
        words.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)))
        lines = [line for line in data.split(b"\n") if line.strip()]
        base.append((len(found), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))))
    out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines"], dtype="int64")
    zero = np.zeros(len(texts), np.int64)
    found = {"n_repeat_words": zero, "n_repeats": zero, "repeated_words": zero, "longest_repeat": zero}
    if out["n_words"].sum():
        flat, of = np.concatenate(words), np.repeat(np.arange(len(texts)), out["n_words"])
        array = SuffixArray(flat, of)
        lcp = array.common()
        longest = np.empty(len(flat), np.int64)  # longest repeat that starts at a word
        longest[array.order] = np.maximum(lcp[:-1], lcp[1:])

        def covered(sizes: np.ndarray) -> np.ndarray:
            """Words of each text in the union of the spans that start at each word."""
            reach = np.maximum.accumulate(np.where(sizes > 0, np.arange(len(sizes)) + sizes, 0))
            return np.bincount(of[reach > np.arange(len(sizes))], minlength=len(texts))
        # spans of the maximal repeats: from each occurrence, the longest repeat that starts there is the one that counts
        # (one that is not maximal lies inside one that starts a word before)
        repeats = array.maximal(lcp, limits.least)
        owners = of[array.order[[first for _, first, _ in repeats]]] if repeats else np.zeros(0, np.int64)
        found = {"n_repeat_words": covered(np.where(longest >= 3, 3, 0)), "n_repeats": np.bincount(owners, minlength=len(texts)),
                 "repeated_words": covered(np.where(longest >= limits.least, longest, 0)), "longest_repeat": zero.copy()}
        np.maximum.at(found["longest_repeat"], owners, np.array([size for size, _, _ in repeats], np.int64))
    for name, values in found.items():
        out[name] = values
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["repeated_words"] <= limits.covered * out["n_words"]) & (out["longest_repeat"] <= limits.longest)
    return out


def repeats(text: str | None, least: int = Limits.least) -> list[tuple[int, list[int]]]:
    """Maximal repeats of one text: length in words, and the words at which it starts."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return []
    number: dict[bytes, int] = {}
    array = SuffixArray(np.array([number.setdefault(w, len(number)) for w in words]), np.zeros(len(words), np.int64))
    return sorted((size, sorted(array.order[a:b + 1].tolist())) for size, a, b in array.maximal(array.common(), least))


STATISTICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_repeats long, repeated_words long, "
              "longest_repeat long, base_failed boolean, kept boolean")


def _parts(texts: pd.Series, limits: Limits) -> Iterator[tuple[int, pd.DataFrame]]:
    """Number of the first text and measures, a bounded number of words at a time."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") // 4  # words are hardly shorter
        if size >= TOGETHER or i + 1 == len(texts):
            yield start, measure(texts.iloc[start:i + 1].tolist(), limits)
            start, size = i + 1, 0


def keeps(text: Column, limits: Limits = Limits()) -> Column:
    """The verdict alone, as a column of a text column."""
    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.concat([part["kept"] for _, part in _parts(texts, limits)], ignore_index=True) if len(texts) else pd.Series([], dtype=bool)
    return kept(text)


def judge(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, statistics and `kept` of every row of docs.

    Words are runs without ASCII white space. n_repeats, repeated_words and longest_repeat are the number of maximal
    repeats of at least `limits.least` words, the words they cover and the longest one's length. A text with fewer than 50 words, or half
    of whose words lie in 3-word windows that occur twice, fails whatever its repeats are; null and empty texts have no words and
    fail so. Null keys and repeated rows are ordinary rows, an empty table gives no rows, further columns are ignored. Every row is
    judged by itself: nothing is shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, done in _parts(b["text"], limits):
                done.insert(0, "doc_id", b["doc_id"].iloc[start:start + len(done)].array)
                yield done
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, " + STATISTICS)


@query("op1_suffix_array_repeats")
def op1_suffix_array_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Quality verdicts of all documents; tested against brute force."""
    return judge(table(spark, folder, "documents"))
