import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import prefix_bpe as bpe


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.coder()


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=" \n\t 'stre1.é\x1c", max_size=40))
def test_equals_tiktoken(reference, coder, text):
    assert ids(coder.encode(text)) == reference.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 40))
def test_appends_and_edits(coder, data, more, a, b):
    v = coder.vocabulary
    plain = lambda d: [v.ranks[t] for t in v.merged(d)]
    state = bpe.Prefixes(v, data)
    state.append(more)
    for end in range(len(data + more) + 1):
        assert state.ids(end) == plain((data + more)[:end])
    start, end = sorted((min(a, len(state.data)), min(b, len(state.data))))
    state.replace(start, end, more)
    whole = data + more
    assert state.data == whole[:start] + more + whole[end:] and state.ids() == plain(state.data)


def test_edits_are_local(coder):
    data = b"there was a reason for every hand on the lake, " * 400
    state = bpe.Prefixes(coder.vocabulary, data)
    assert state.replace(5000, 5004, b"quite") < 200
    assert state.data[5000:5005] == b"quite" and state.ids() == bpe.Prefixes(coder.vocabulary, state.data).ids()


def test_long_pieces(reference, coder):
    for text in ("a" * 20_000, " " * 5000, "é" * 3000 + "\n" * 900 + "x"):
        assert ids(coder.encode(text)) == reference.encode_ordinary(text)


def test_operator(spark, make_docs, odd_texts, reference):
    docs = make_docs(odd_texts, ids=[None, *range(1, len(odd_texts))])
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    lists = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    back = {r["doc_id"]: bytes(r["text"]) for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, text in enumerate(odd_texts):
        want, row = reference.encode_ordinary(text or ""), got[i or None]
        assert row["n_tokens"] == len(want) and row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert lists[i or None] == want and back[i or None] == (text or "").encode()
    assert bpe.digests(docs.limit(0)).collect() == []
