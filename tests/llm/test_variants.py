import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from colonnade.llm import variants

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute(rows, least_n=5):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= least_n}
    near, form = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in LETTERS} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
        near[w] = sorted((x for x in edits if x != w and x in n), key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def texts(r, words=60, docs=80):
    base = ["".join(r.choice("etaoinshrdlué÷Ö") for _ in range(r.randint(6, 11))) for _ in range(words)]
    base += [w[:3] + r.choice(LETTERS) + w[3:] for w in base[:30]] + [w[:2] + w[3:] for w in base[:30]] + [w[:4] + r.choice(LETTERS) + w[5:] for w in base[:30]]
    base += ["".join(r.sample(w, len(w))) for w in base[:20]]  # equal counts in another order
    weight = [r.choice([1, 1, 2, 40]) for _ in base]
    return [r.choice([" ", ", ", "9", "_"]).join(r.choices(base, weight, k=120)).replace("e", r.choice("eE")) for _ in range(docs)]


@pytest.mark.parametrize("limit", [4000, 7])
def test_equals_brute_force(spark, make_docs, odd_texts, limit):
    r = random.Random(4)
    long = "ab" * 400
    rows = [*texts(r), "stromern " * 6 + "stromerne " * 40 + "stromernes " * 300, None, "", *odd_texts, *[f"{long} {long}a {long[1:]} {'xyz' * 13} {'xyz' * 13}x {'xyz' * 13}xy {'xyz' * 13}xyz x{'xyz' * 12}xyz"] * 6]
    ids = [None, 3, 3, *range(10, len(rows) + 7)]
    got = sorted((tuple(x) for x in variants.variants(make_docs(rows, ids=ids), limit=limit).collect()))
    want = brute(zip(ids, rows))
    assert got == want
    assert any(x[1] and x[2] != x[1] for x in want) and max(x[4] for x in want) > 2 and {39, 40, 41} <= {len(x[0]) for x in want}


def test_equal_letters_are_dealt_to_parts(spark):
    r = random.Random(6)
    words = {"".join(r.sample("abcdefg", 7)) for _ in range(300)} | {"".join(r.sample("abcdefg", 7)) + "h" for _ in range(300)}
    words |= {"".join(r.sample("abcdefh", 7)) for _ in range(300)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    top = variants.cells(df, 20)
    assert top.whole and max(top.count[i] for i in top.whole) > 20
    got = {(x["a"], x["b"]) for x in variants.near_pairs(df, 20).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and variants.one_edit(a.encode(), b.encode())} and got


def test_trees_prune():
    r = np.random.default_rng(2)
    words = ["".join(chr(97 + int(x)) for x in r.zipf(1.4, 8) % 26).encode() for _ in range(3000)]
    v = variants.vectors(words)
    tree, checked, pairs = variants.Tree(v), 0, 0
    plain = variants._outside
    for q, m in tree.within(v[:200], 2):
        pairs += len(q)
    leaves = [rows for _, _, children, rows in tree.nodes if not children]
    for lo, hi, children, rows in tree.nodes:
        if not children:
            checked += len(rows) * int((plain(v[:200], lo, hi) <= 2).sum())
    counts = np.array([[min(2, w.count(bytes([c]))) for c in range(97, 123)] for w in words])
    assert sum(map(len, leaves)) == 3000 and pairs == int((np.abs(counts[:200, None] - counts[None]).sum(axis=2) <= 2).sum())
    assert checked < 200 * 3000 / 2


def test_no_rows(spark, make_docs):
    assert variants.variants(make_docs([])).collect() == [] and variants.variants(make_docs([None, "few words", ""])).collect() == []
