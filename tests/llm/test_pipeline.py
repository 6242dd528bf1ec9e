import random
from collections import defaultdict

import corpus_pipeline
from compare import connect
from test_packing import reference
from test_quality import brute
from test_shingles import brute_components

from colonnade.llm import packing, quality, secrets, toxicity


def brute_pipeline(spark, rows, folder):
    """Kept documents after each stage, over plain lists; the trained network is the stage's own, as it has no other definition."""
    after = {}
    rows = [r for r in rows if brute(r["text"], quality.Limits())["kept"]]
    after["quality"] = rows
    net, limits = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
                               spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in rows if toxicity.scores(net, [r["text"]])[0] < limits.get(r["lang"], 0.5)]
    after["toxicity"] = rows
    rows = sorted(rows, key=lambda r: r["doc_id"])
    roots = brute_components([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    after["near_duplicates"] = rows
    forest, rows = secrets.default_forest(), [dict(r) for r in rows]
    for r in rows:
        for start, length, _, score in reversed(secrets.scored(r["text"], forest)):
            if score >= 0.5:
                r["text"] = r["text"][:start] + secrets.MASK + r["text"][start + length:]
                r["n_chars"] = len(r["text"])
    after["secrets"] = rows
    return after


def short(table):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table)


def test_stages_equal_brute_force(spark, tmp_path, data):
    con = connect(data)
    rows = con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE length(text) < 1500 ORDER BY doc_id").fetchall()
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    r = random.Random(3)
    own = [" ".join(r.choice(["oak", "elm", "ash", "yew", "fir"]) + str(r.randint(0, 40)) for _ in range(90)) for _ in range(5)]
    for text in own[:4] + own[:2] + [own[4] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "", "short"]:
        rows.append({"doc_id": 10_000 + len(rows), "text": text, "lang": None, "source": "src", "n_chars": None if text is None else len(text)})
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    want, docs = brute_pipeline(spark, [dict(x) for x in rows], str(tmp_path)), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert short(docs.collect()) == short(want[name]), name
    assert any(secrets.MASK in x["text"] for x in want["secrets"])
    ids_of, pieces = reference(), defaultdict(int)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p["doc_id"]] += p["length"]
    assert pieces == {x["doc_id"]: len(ids_of(x["text"])) + 1 for x in want["secrets"]}


def test_odd_tables(spark, make_docs, odd_texts, tmp_path):
    docs = make_docs(odd_texts, ids=[None, *[3] * (len(odd_texts) - 1)])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    # rows with one id are documents of their own, and rows without id are members like others
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(set(brute_components(odd_texts)))
    other = make_docs(["oak elm ash yew fir " * 3, "one two three four five six", "seven eight nine ten one two", None, "seven eight nine ten one two"], ids=[1, 1, None, None, None])
    kept = corpus_pipeline.near_duplicates(spark, other, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "seven eight nine ten one two"), (1, "oak elm ash yew fir " * 3), (1, "one two three four five six")]
    for table, some in ((docs, True), (docs.limit(0), False)):
        table.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == some


def test_query_is_registered(spark):
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names and packing.ROOM == 2048


def test_python_gets_few_rows_of_texts_at_a_time(spark, make_docs, tmp_path):
    """10,000 rows a batch and 450,000 kept words took an executor beyond its memory in packing."""
    import pandas as pd

    docs = make_docs(["oak elm ash"] * 2500).coalesce(1)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get(corpus_pipeline.ROWS_A_BATCH)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "near_duplicates":
                spark.conf.set(corpus_pipeline.ROWS_A_BATCH, "10000")
                stage(spark, docs, str(tmp_path))
                sizes = docs.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
                assert sum(r["n"] for r in sizes) == 2500 and max(r["n"] for r in sizes) <= 1000, name
    finally:
        spark.conf.set(corpus_pipeline.ROWS_A_BATCH, before)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get(corpus_pipeline.ROWS_A_BATCH) == before
