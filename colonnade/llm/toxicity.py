"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import kept_by_worker, uniform31
from colonnade.llm.registry import query, table
from colonnade.session import stage

TOGETHER = 100_000  # words of texts scored at a time
STEPS = 256  # steps of the score for one unit of log-odds; log-odds lie within 30


@dataclass(frozen=True)
class Settings:
    """Sizes and training. Of the labelled rows outside the held-out fold at most `per_label` of each label train the network: those with
    the smallest hashes. They are the only bound; everything is scored."""
    rows: int = 1 << 15  # of the embedding table
    width: int = 16
    filters: tuple[tuple[int, int], ...] = ((1, 16), (2, 8), (3, 8))  # (words, number)
    per_label: int = 2500
    epochs: int = 6
    steps: int = 600  # at least so many batches, for small sets of labels
    batch: int = 32
    rate: float = 0.01
    seed: int = 7
    calibration: int = 5  # every n-th sampled row trains nothing, so that small tables have rows for thresholds too
    precision: float = 0.9  # that a language's threshold must reach on the labelled rows that train nothing
    few: int = 10  # languages with fewer toxic rows among those take the threshold of all languages


SETTINGS = Settings()


def features(word: bytes, rows: int) -> tuple[int, int, int, int]:
    """Rows of the embedding table for a lower-cased word: its hash and those of its first three, four and five letters, so that
    inflected forms share most of their embedding."""
    text = word.decode("utf-8", "replace").strip(".,;:!?\"'()[]#*$%&|<>")
    return tuple(crc32(f"{n}{text[:n] if n else text}".encode()) % rows for n in (0, 3, 4, 5))


class KnownWords:
    """Features of the words that a worker has met, dropped when there are too many."""

    def __init__(self, rows: int, most: int = 150_000):
        self.rows, self.most, self.place, self.table = rows, most, {}, np.empty((most, 4), np.int32)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place, new = {}, words
        if len(new) > self.most:  # one very long text
            return np.array([features(w, self.rows) for w in words], np.int32)
        for w in new:
            self.table[len(self.place)] = features(w, self.rows)
            self.place[w] = len(self.place)
        return self.table[[self.place[w] for w in words]] if words else np.empty((0, 4), np.int32)


@dataclass
class Network:
    """Embeddings, filters of several widths, the largest activation of each over the text, and a logistic unit."""
    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> Network:
        s, random = self.settings, np.random.default_rng(self.settings.seed)
        self.weights = {"embedding": random.normal(0, 0.3, (s.rows, s.width)).astype(np.float32)}
        for words, number in s.filters:
            self.weights[f"filter{words}"] = random.normal(0, (words * s.width) ** -0.5, (words, s.width, number)).astype(np.float32)
            self.weights[f"bias{words}"] = np.zeros(number, np.float32)
        self.weights["out"] = random.normal(0, 0.3, sum(n for _, n in s.filters)).astype(np.float32)
        self.weights["base"] = np.full(1, -1.0, np.float32)
        return self

    def forward(self, table: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Pooled activations of texts whose words are words[starts[i]:starts[i + 1]], as rows of `table` (the features of each
        distinct word); also the word at which each largest activation starts, and the words' embeddings.

        A filter's part for one word depends on that word only, so it is computed once per distinct word and added up
        along the text. Texts shorter than a filter, and empty ones, see zeros there."""
        w, of_word = self.weights, self.weights["embedding"][table].mean(axis=1)
        count, pooled, where = len(starts) - 1, [], []
        last = np.repeat(starts[1:], np.diff(starts))  # end of each word's text
        full = np.flatnonzero(np.diff(starts))
        for size, number in self.settings.filters:
            part = np.einsum("vd,sdf->svf", of_word, w[f"filter{size}"])
            value = np.zeros((len(words), number), np.float32)
            for s in range(size):
                here = np.arange(len(words) - s)
                here = here[here + s < last[here]]
                value[here] += part[s][words[here + s]]
            best, at = np.zeros((count, number), np.float32), np.full((count, number), -1, np.int64)
            if len(full):
                best[full] = np.maximum.reduceat(value, starts[full], axis=0)
                self._find(value, best, starts, full, at)
            pooled.append(np.maximum(best + w[f"bias{size}"], 0))
            where.append(at)
        return np.concatenate(pooled, axis=1), where, of_word

    @staticmethod
    def _find(value: np.ndarray, best: np.ndarray, starts: np.ndarray, full: np.ndarray, at: np.ndarray) -> None:
        if at.size and len(full) <= 64:  # in training only
            for i in full.tolist():
                at[i] = starts[i] + value[starts[i]:starts[i + 1]].argmax(axis=0)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights["out"] + self.weights["base"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def _numbered(texts: list[list[bytes]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words, and words and starts of the texts."""
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    known = kept_by_worker(f"word features {rows}", lambda: KnownWords(rows))
    table = known.rows_of(list(number))
    return table, flat, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def train(texts: list[str | None], labels: list[int], settings: Settings = SETTINGS) -> Network:
    """Adam on the logistic loss; both classes weigh the same. Only the words at which a filter is largest get gradients."""
    net, random = Network(settings).start(), np.random.default_rng(settings.seed)
    split, y = [words_of(t) for t in texts], np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return net
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for _ in range(max(settings.epochs, -(-settings.steps * settings.batch // len(y)))):
        order = random.permutation(len(y))
        for i in range(0, len(y), settings.batch):
            chosen = order[i:i + settings.batch]
            table, words, starts = _numbered([split[j] for j in chosen], settings.rows)
            pooled, where, of_word = net.forward(table, words, starts)
            slope = ((net.score(pooled) - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in net.weights.items() if k != "embedding"}
            grads["out"], grads["base"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
            to_word = np.zeros_like(of_word)
            column = 0
            for (size, number), at in zip(settings.filters, where):
                down = slope[:, None] * net.weights["out"][column:column + number] * (pooled[:, column:column + number] > 0)
                column += number
                grads[f"bias{size}"] = down.sum(axis=0)
                text, which = np.nonzero((at >= 0) & (down != 0))
                places, values, ends = at[text, which], down[text, which], starts[text + 1]
                for s in range(size):
                    inside = places + s < ends
                    word = words[places[inside] + s]
                    np.add.at(grads[f"filter{size}"][s].T, which[inside], values[inside, None] * of_word[word])
                    np.add.at(to_word, word, values[inside, None] * net.weights[f"filter{size}"][s].T[which[inside]])
            step += 1
            touched = np.flatnonzero(np.abs(to_word).sum(axis=1))
            rows, spot = np.unique(table[touched], return_inverse=True)
            part = np.zeros((len(rows), settings.width), np.float32)
            np.add.at(part, spot.reshape(-1), np.repeat(to_word[touched] / 4, 4, axis=0))
            for name, grad in [*grads.items(), ("embedding", part)]:
                at = rows if name == "embedding" else slice(None)
                first[name][at] = 0.9 * first[name][at] + 0.1 * grad
                second[name][at] = 0.999 * second[name][at] + 0.001 * grad**2
                move = first[name][at] / (1 - 0.9**step) / (np.sqrt(second[name][at] / (1 - 0.999**step)) + 1e-8)
                net.weights[name][at] -= settings.rate * move
    return net


def scores(net: Network, texts: list[str | None]) -> np.ndarray:
    table, words, starts = _numbered([words_of(t) for t in texts], net.settings.rows)
    return net.score(net.forward(table, words, starts)[0])


def threshold(score: np.ndarray, label: np.ndarray, precision: float) -> float:
    """The lowest of the scores, and of 0.5 if none does, at which the rows at or above it are toxic in at least the wanted share;
    half way to the next lower score, so that it lies in the gap."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
    last = np.flatnonzero((share >= precision) & (label[order] == 1))
    if not len(last):
        return 0.5
    lowest = score[order[last[-1]]]
    below = score[score < lowest]
    return float((lowest + below.max()) / 2 if len(below) else lowest / 2)


def remainder(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; the held-out fold is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> tuple[Network, DataFrame, list[int]]:
    """The network, the labelled rows outside the held-out fold (doc_id, toxic), and the ids of those that trained it: a bounded sample. The driver
    gets settings.per_label rows of each label at most, with their whole texts. Labels are reduced to one row per doc_id (the largest) and matched by doc_id."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    able = marked.where(remainder(F.col("doc_id")) != 0)
    order = uniform31(F.lit(settings.seed), F.col("doc_id"))
    parts = [able.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(settings.per_label) for t in (1, 0)]
    wanted = parts[0].unionByName(parts[1])  # bounded by settings.per_label
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").orderBy("doc_id").limit(2 * settings.per_label).toPandas()
    rows = rows.sort_values(["doc_id", "text"], na_position="first", ignore_index=True)
    aside = np.arange(len(rows)) % settings.calibration == 0
    net = train(rows["text"][~aside].tolist(), rows["toxic"][~aside].tolist(), settings)
    return net, able, rows["doc_id"][~aside].unique().tolist()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> tuple[Network, dict[str, float]]:
    """Network and thresholds by language from the labelled rows outside the held-out fold: a bounded sample trains the network, all others
    set the thresholds."""
    net, able, trained = learn(docs, labels, settings)
    return net, calibrate(scored(docs, net), able, trained, settings)


def calibrate(rows: DataFrame, able: DataFrame, trained: list[int], settings: Settings = SETTINGS) -> dict[str, float]:
    """Thresholds by language from the scores (doc_id, lang, score) of all rows of `able` (doc_id, toxic) but the trained ones, which are a bounded list.
    Rows that stay are weighted so that each language has the share of toxic rows that it has with the trained ones. Scores meet
    labels, texts do not; Spark counts by language and step of the score, and the driver sees those counts."""
    spark = rows.sparkSession
    met = rows.select("doc_id", "lang", "score").join(able, "doc_id")
    used = spark.createDataFrame([(i, True) for i in trained], "doc_id long, used boolean")  # at most twice settings.per_label
    step = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * STEPS).cast("int").alias("step")
    counts = met.join(F.broadcast(used), "doc_id", "left").groupBy("lang", "toxic", step, "used").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts["lang"] = counts["lang"].astype(object).where(counts["lang"].notna(), None)
    every = counts.groupby(["lang", "toxic"], dropna=False)["n"].transform("sum")
    left = counts["used"].isna()
    steps = counts[left].assign(weight=every[left])
    if not len(steps):
        return {}
    steps["weight"] = steps["n"] * steps["weight"] / steps.groupby(["lang", "toxic"], dropna=False)["n"].transform("sum")
    pooled = threshold_of_steps(steps, settings.precision)
    by_language = {}
    for lang, own in steps.dropna(subset="lang").groupby("lang"):
        enough = own["n"][own["toxic"] == 1].sum() >= settings.few
        by_language[lang] = threshold_of_steps(own, settings.precision) if enough else pooled
    return by_language


def threshold_of_steps(steps: pd.DataFrame, precision: float) -> float:
    """`threshold` from the weights of toxic and other rows by step of the score: half way, in log-odds, to the next lower step that has rows."""
    at = steps.assign(hits=steps["weight"] * (steps["toxic"] == 1)).groupby("step")[["hits", "weight"]].sum().sort_index(ascending=False)
    share = at["hits"].cumsum() / at["weight"].cumsum()
    last = np.flatnonzero((share >= precision - 1e-9) & (at["hits"] > 0))
    if not len(last):
        return 0.5
    lowest = at.index[last[-1]]
    odds = (lowest + (at.index[last[-1] + 1] + 1 if last[-1] + 1 < len(at) else lowest - STEPS)) / 2 / STEPS
    return float(1 / (1 + np.exp(-odds)))


def _parts(net: Network, texts: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the first text and scores, a bounded number of words at a time."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") // 4
        if size >= TOGETHER or i + 1 == len(texts):
            yield start, scores(net, texts.iloc[start:i + 1].tolist())
            start, size = i + 1, 0


def scored(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang and score of every row. Scores come from texts alone. The network (about 2 MB whatever the input) goes to the workers with
    the function; a row's text is scored whole, `TOGETHER` words of texts at a time."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, score in _parts(model.value, b["text"]):
                yield b.iloc[start:start + len(score)][["doc_id", "held_out", "lang"]].assign(score=score)
    column = F.col(f"`{key}`").cast("long")
    rows = docs.select(column.alias("doc_id"), F.coalesce(remainder(column) == 0, F.lit(False)).alias("held_out"),
                       F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang string, score double")


def score_of(spark: SparkSession, net: Network) -> Callable[[Column], Column]:
    """The score as a function of a text column."""
    model = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *(part for _, part in _parts(model.value, texts))]))
    return score


def flagged(score: Column, lang: Column, by_language: dict[str, float]) -> Column:
    """Whether a score reaches its language's threshold, 0.5 for languages without one."""
    limits = F.create_map(*[F.lit(x) for item in by_language.items() for x in item]) if by_language else None
    return score >= (F.lit(0.5) if limits is None else F.coalesce(F.try_element_at(limits, lang), F.lit(0.5)))


def verdicts(rows: DataFrame, by_language: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and flagged (score at least the language's threshold) from `scored` rows."""
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       flagged(F.col("score"), F.col("lang"), by_language).alias("flagged"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """`verdicts` of every row of docs with a network and thresholds learned from its labelled rows. Every text is scored once, in place; the scores
    are a table that the labels join for the thresholds, and no text is shuffled. Null and empty texts have the network's base score; null
    keys are outside the held-out fold; repeated rows are ordinary rows, no rows give no rows, further columns are ignored."""
    net, able, trained = learn(docs, labels, settings)
    rows = stage(scored(docs, net), "scores")
    return verdicts(rows, calibrate(rows, able, trained, settings))


@query("op6_text_cnn")
def op6_text_cnn(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents; tested by its accuracy on the held-out fold."""
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
