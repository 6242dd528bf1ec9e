import zlib
from collections import Counter, defaultdict

import pytest

from colonnade.llm import shards


def check(rows, count, of):
    sizes = Counter(r["shard"] for r in rows)
    total = len(rows)
    assert sorted(sizes.get(s, 0) for s in range(count)) == sorted([total // count + 1] * (total % count) + [total // count] * (count - total % count))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, mixed = Counter(map(of, rows)), Counter((of(r), r["shard"]) for r in rows)
    for source, n in share.items():
        for s in range(count):
            assert abs(mixed[source, s] - n * sizes.get(s, 0) / total) <= 2 + n / total * len(share) ** 0.5, (source, s)


@pytest.mark.parametrize("total", [0, 1, 5, 24, 1000])
def test_mixture(spark, make_docs, total):
    sources = ["hot" if i % 3 else None if i % 7 == 0 else f"s{i % 40}" if i % 2 else f"only{i}" for i in range(total)]
    docs = make_docs([f"text {i}" for i in range(total)], sources=sources)
    rows = shards.interleave(docs).collect()
    assert len(rows) == total and sorted(r["doc_id"] for r in rows) == list(range(total))
    check(rows, 24, lambda r: r["source"])
    if total == 1000:
        again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.interleave(docs.repartition(7)).collect()}
        assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
        other = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.interleave(docs, seed=3).collect()}
        assert other != again


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts * 2, ids=[None] * len(odd_texts) + [3] * len(odd_texts))
    rows = shards.interleave(docs, shards=5).collect()
    assert Counter(r["text"] for r in rows) == Counter(odd_texts * 2)
    assert rows[0]["rank"] is not None and set(docs.columns) <= set(rows[0].asDict())  # columns of docs stay, shard is replaced
    check(rows, 5, lambda r: r["source"])


def test_query(spark, data):
    rows = shards.op8_stratified_interleaving(spark, data).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
    check(rows, 24, lambda r: r["source"])


def test_files_hold_whole_shards(spark, make_docs, tmp_path):
    docs = make_docs([f"t{i}" for i in range(100)])
    shards.write_shards(shards.interleave(docs, shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r["shard"] for r in back.collect()) == {0: 25, 1: 25, 2: 25, 3: 25}
