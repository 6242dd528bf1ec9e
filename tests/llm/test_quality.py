from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import quality

texts = st.lists(st.text(alphabet="ab \n#é ", max_size=60), min_size=1, max_size=4)


def brute(text, limits):
    """Straight from the definitions, in quadratic time."""
    words = (text or "").encode().split()
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            size = 0
            while i != j and max(i, j) + size < n and words[i + size] == words[j + size]:
                size += 1
            longest[i] = max(longest[i], size)
    windows = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    repeated = {j for i in range(n - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    covered = {j for i in range(n) if longest[i] >= limits.least for j in range(i, i + longest[i])}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    most = max([x for x in longest if x >= limits.least], default=0)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return {"n_words": n, "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "repeated_words": len(covered), "longest_repeat": most,
            "base_failed": failed, "kept": not failed and len(covered) <= limits.covered * n and most <= limits.longest}


@settings(max_examples=120, deadline=None)
@given(texts)
def test_measures_equal_brute_force(texts):
    limits = quality.Limits(least=3)
    got = quality.measure([*texts, None, ""], limits)
    for text, row in zip([*texts, None, ""], got.to_dict("records")):
        want = brute(text, limits)
        assert {k: row[k] for k in want} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=25))
def test_maximal_repeats(words):
    found = []
    for size in range(2, len(words)):
        at = {}
        for i in range(len(words) - size + 1):
            at.setdefault(tuple(words[i:i + size]), []).append(i)
        for where in at.values():
            left = {words[i - 1] if i else i - 1 for i in where}
            right = {words[i + size] if i + size < len(words) else len(words) for i in where}
            if min(len(where), len(left), len(right)) > 1:
                found.append((size, where))
    assert quality.repeats(" ".join(words), 2) == sorted(found)


def test_long_repeat_and_coverage():
    random = np.random.default_rng(2)
    fresh = lambda n: " ".join(f"w{x}" for x in random.integers(0, 10**9, n))
    passage, few = fresh(60), fresh(12)
    clean, long, mild = fresh(400), f"{passage} {fresh(300)} {passage}", f"{few} {fresh(100)} {few}"
    got = quality.measure([clean, long, mild])
    assert got["kept"].tolist() == [True, False, True] and got["longest_repeat"].tolist() == [0, 60, 12]
    assert got["base_failed"].tolist() == [False, False, False] and got["repeated_words"].tolist() == [0, 120, 24]


def test_operator(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts, ids=[None, *range(1, len(odd_texts))])
    got = {r["doc_id"]: r.asDict() for r in quality.judge(docs).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        if len(text or "") < 3000:
            want = brute(text, quality.Limits())
            assert {k: got[i or None][k] for k in want} == want, text
    assert quality.judge(docs.limit(0)).collect() == []
    kept = docs.where(quality.keeps(docs["text"])).count()
    assert kept == sum(r["kept"] for r in got.values())
