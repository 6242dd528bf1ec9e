import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from colonnade.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= radius:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab É\n\tZ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1) | st.integers(0, 255), max_size=40), st.integers(0, 4))
def test_tree_finds_all_within(values, radius):
    v = np.array(sorted(values), np.uint64)
    got = {(n, q) for n, near in simhash.Tree(v).within(v, radius) for q in near.tolist()}
    assert got == {(i, j) for i in range(len(v)) for j in range(len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= radius}


def test_links_lose_no_component(spark):
    """Near values of all kinds, in shards that are searched at once and in ones that are dealt again."""
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(60)]
    values = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for s in seeds for _ in range(4)}
    values |= {s ^ (1 << r.randrange(64)) for s in seeds[:1] for _ in range(60)} | {x << 58 for x in range(40)} | set(range(50))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components(values)
    for limit in (4096, 3):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, 2, limit)).collect()}
        label = [got.get(v, v) for v in signed]
        assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_components_of_a_chain_and_a_star(spark):
    r = random.Random(8)
    chain = list(range(1000, 1060))
    edges = list(zip(chain, chain[1:])) + [(5, x) for x in range(100, 400)] + [(-7, -3), (3, 3)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 1000 for x in chain} | {x: 5 for x in [5, *range(100, 400)]} | {-7: -7, -3: -7}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_operator(spark, make_docs, odd_texts):
    r = random.Random(9)
    base = [" ".join(r.choice("abcdefghijk") * r.randint(1, 3) for _ in range(300)) for _ in range(12)]
    near = [" ".join(w if r.random() > 0.004 else "zz" for w in t.split()) for t in base for _ in range(4)]
    texts = odd_texts + base + near + base[:5] + ["copied text here"] * 40
    ids = [None, *range(200, 200 + len(texts) - 2), 205]
    rows = simhash.near_duplicates(make_docs(texts, ids=ids)).collect()
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(prints)
    least = {}
    for i, root in zip(ids, roots):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted((i or 0, f"{p:016x}", least[root] or 0) for i, p, root in zip(ids, prints, roots))
    assert sorted((x["doc_id"] or 0, x["fingerprint"], x["component_id"] or 0) for x in rows) == want
    assert simhash.near_duplicates(make_docs([])).collect() == []
