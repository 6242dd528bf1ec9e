import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colonnade.llm import packing


def reference(marks_as_text=False):
    t = Tokenizer.from_file(packing.VOCABULARY)
    t.encode_special_tokens = marks_as_text
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aBé's 1.́ \x1c<|>endoftext", max_size=40))
def test_ids_are_the_tokenizers(text):
    want = reference.__dict__.setdefault("made", None) or reference()
    reference.__dict__["made"] = want
    assert np.frombuffer(packing.coder().encode(text), "<u4").tolist() == want(text)


def test_marks_are_special_unless_asked_otherwise():
    for text in ("a <|endoftext|> b", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext |>"):
        assert np.frombuffer(packing.Coder().encode(text), "<u4").tolist() == reference()(text)
        assert np.frombuffer(packing.Coder(marks_as_text=True).encode(text), "<u4").tolist() == reference(True)(text)


def test_few_kept_words_give_the_same_ids(spark, make_docs, odd_texts):
    few, text = packing.Coder(kept=3), "oak elm ash yew fir don't oak zwölf elm 12 ash 7 yew"
    assert np.frombuffer(few.encode(text), "<u4").tolist() == reference()(text) and max(len(few.words), len(few.known)) <= 3
    docs = make_docs(odd_texts)
    few, all_kept = [sorted(map(str, packing.pieces(docs, kept=n).collect())) for n in (3, packing.KEPT_WORDS)]
    assert few == all_kept


def brute_packs(lengths, room):
    """Every piece on its own, longest first, into a pack with the most room left."""
    left = []
    for length in sorted(lengths, reverse=True):
        most = max(left, default=-1)
        if most < length:
            left.append(room - length)
        else:
            left[left.index(most)] = most - length
    return Counter(left)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=150))
def test_patterns_equal_one_by_one(lengths):
    packed = packing.patterns(Counter(lengths), 32)
    got = Counter()
    for made, count in packed:
        got[32 - sum(length * times for length, times in made)] += count
    assert got == brute_packs(lengths, 32)


def test_columns_of_any_name_go_along(spark):
    names = ["first", "end", "sequence", "sequences", "at", "rank", "offsets"]
    rows = [(i, 0, 5 + i % 3, i, 5 + i % 3, *[f"{n}{i}" for n in names]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + ", ".join(f"`{n}` string" for n in names if n != "rank").replace("sequence` string", "sequence` string") + ", `rank_` string")
    out = packing.pack(df, 16)
    assert out.columns == [*df.columns, "sequence_id", "offset"] and out.count() == 40


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_place_everything_once(histogram):
    packed = packing.patterns(histogram, 64)
    used = Counter()
    for made, count in packed:
        assert sum(length * times for length, times in made) <= 64 and count > 0
        for length, times in made:
            used[length] += times * count
    assert used == Counter(histogram)


def test_shortest_pack_first():
    assert packing.patterns({60: 2, 40: 3, 30: 1}, 100) == [([(40, 1), (30, 1)], 1), ([(60, 1), (40, 1)], 2)]


def test_operator(spark, make_docs, odd_texts):
    r = random.Random(4)
    texts = odd_texts + [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 900))) for _ in range(300)] + ["same text"] * 150
    docs = make_docs(texts, ids=[*range(len(texts) - 2), 7, None])
    rows = packing.pack(packing.pieces(docs)).collect()
    ids_of, sequences, seen = reference(), defaultdict(list), defaultdict(list)
    for row in rows:
        data = np.array(row["ids"], "<u4")
        assert row["length"] == len(data) and row["ids_crc32"] == zlib.crc32(data.tobytes())
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
        seen[row["doc_id"], row["doc_tokens"]].append((row["start"], row["ids"]))
    for parts in sequences.values():  # gapless, without overlap, and within the room
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.ROOM
    assert sorted(sequences) == list(range(len(sequences)))
    for i, text in zip([*range(len(texts) - 2), 7, None], texts):
        want = [*ids_of(text), packing.END]
        parts = sorted(seen[i, len(want)])
        assert [x for _, part in parts for x in part][:len(want)] == want
    total = sum(row["length"] for row in rows)
    assert total == sum(len(ids_of(t)) + 1 for t in texts) and total > 0.95 * packing.ROOM * (len(sequences) - 1)
    assert packing.pack(packing.pieces(docs.limit(0), ids=False)).collect() == []
