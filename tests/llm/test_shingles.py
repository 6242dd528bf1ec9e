import random

import corpus_pipeline
import pytest

from colonnade.llm import shingles


def brute_sets(texts):
    split = ["".join(c.lower() if c.isascii() else c for c in t or "").encode().split() for t in texts]
    return [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def brute_components(texts):
    sets, root = brute_sets(texts), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def planted(r):
    """Texts, copies with ever more edits or a header, and texts that share a long passage without being copies."""
    fresh = lambda n: [f"{r.choice(['oak', 'elm', 'ash', 'yew'])}{r.randrange(10**6)}" for _ in range(n)]
    base = [fresh(r.randint(60, 250)) for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for words in base:
        for edits in range(1, 7):
            copy = list(words)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = fresh(1)[0]
            texts.append(" ".join(copy))
        texts.append(" ".join(fresh(6) + words))
    passage = fresh(60)
    texts += [" ".join(passage + fresh(60)) for _ in range(15)]
    # mostly common passages, some of them copies but for a few words
    own = [fresh(n) for n in (4, 6, 9, 12, 12, 16)]
    return texts + [" ".join(passage * 2 + w) for w in own] + [" ".join(passage + passage[:30] + w + fresh(1)) for w in own]


@pytest.mark.parametrize("limit", [256, 2])
def test_equals_brute_force(spark, make_docs, odd_texts, limit):
    r = random.Random(5)
    texts = planted(r)
    texts += texts[:3] + odd_texts
    r.shuffle(texts)
    ids = [None, *range(100, 100 + len(texts) - 2), 105]
    roots, least = brute_components(texts), {}
    for i, root in zip(ids, roots):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    got = shingles.near_duplicates(make_docs(texts, ids=ids), limit=limit).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in got) == sorted((i or 0, least[root] or 0) for i, root in zip(ids, roots))
    assert shingles.near_duplicates(make_docs([])).collect() == []


def test_links_come_through_fingerprints(spark, make_docs, monkeypatch):
    """Light copies are found by the fingerprints and BK-trees of the named method, before any shingle is shared out."""
    texts, asked, seen = planted(random.Random(5)), [], shingles.fingerprint_pairs

    def watched(sets):
        asked.append({(r["a"], r["b"]) for r in seen(sets).collect()})
        return seen(sets)
    monkeypatch.setattr(shingles, "fingerprint_pairs", watched)
    roots = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(make_docs(texts)).collect()}
    assert len(asked) == 1 and asked[0] and len({(roots[i], c) for i, c in got.items()}) == len(set(roots))


def test_stage_drops_edited_copies(spark, make_docs):
    """Copies whose five-word shingles agree to 0.8 to 0.95, which two bits of a fingerprint miss."""
    texts = planted(random.Random(8))
    sets, roots = brute_sets(texts), brute_components(texts)
    light = [i for i in range(12, len(texts)) if any(0.8 <= len(sets[i] & s) / len(sets[i] | s) <= 0.95 for s in sets[:12])]
    assert len(light) > 20
    kept = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, make_docs(texts), "").collect()}
    assert kept == {i for i, root in enumerate(roots) if root == i} and not kept & set(light)


def test_a_worker_keeps_the_values_of_one_operator_and_near_duplicates_none():
    """What packing, scoring and the like keep would add up over a session, and near-duplicates need the memory themselves."""
    import sys

    from colonnade.llm import common

    common.keep_nothing()
    made = [common.kept_by_worker(name, lambda n=name: [n]) for name in ("packing", "toxicity", "toxicity")]
    assert made[1] is made[2] and vars(sys)["_colonnade_kept"] == {"toxicity": ["toxicity"]}
    common.keep_nothing()
    assert vars(sys)["_colonnade_kept"] == {}
