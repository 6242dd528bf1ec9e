import numpy as np
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that operators use themselves
                     T.StructField("shard", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts: ids 0, 1, ...; None stands for a null text."""
    def make(texts, ids=None, sources=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["src0"] * len(texts))[k], None if t is None else len(t), "x", k, None)
                for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeated rows, a long text, letters outside ASCII."""
    random = np.random.default_rng(1)
    words = ["the", "of", "Und", "élan", "x1", "—", "zwölf", "a.b", "don't"]
    long = " ".join(random.choice(words, 30_000))
    return [None, "", " \n\t ", "word", "word", "one two", "one two three", "one two three", long, long + " end", "é\n\nü  ß", "日本語 テキスト", "á İ ǆ",
            *[" ".join(random.choice(words, n)) for n in (3, 10, 60, 200)]]
