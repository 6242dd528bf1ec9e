"""Headers: applying, checking, naming, finding and their language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions import language, names
from colonnade.operators import stats

# The language model: slots per language, multipliers of a trigram's code points, code points taken at once, count arrays per task, models in all.
SLOTS, GRAM, PIECE, HELD, MODELS = 1 << 16, (7919, 104729, 1299709), 1 << 20, 64, 512
# Words common in headers and the shape of a header item.
COMMON_TERMS = ["id", "name", "date", "email", "price", "cost", "amount", "quantity", "address", "phone"]
ITEM_SHAPE = r"^[A-Za-z_][A-Za-z0-9_\s\-]*$"
PLAIN_SHAPES = r"^[A-Za-z_]([A-Za-z0-9_]*|[A-Za-z0-9_\s]*|[A-Za-z0-9_\-]*)$"


def apply_header(df: DataFrame, header: list[str], drop_first_by: str | None = None) -> DataFrame:
    """Renames all columns; ``drop_first_by`` also drops one row, the first one with the smallest value of that (old) column,
    for data that holds its own header. Ties and rows without a value stay."""
    if len(header) != len(df.columns):
        raise ValueError(f"header has {len(header)} names, table has {len(df.columns)} columns")
    if drop_first_by:
        # the row is told by its content, which no other partitioning changes; of rows that are equal in all cells one goes
        key = stats.quoted(drop_first_by)
        placed = df.withColumn("_content", F.xxhash64(*[stats.quoted(c) for c in df.columns]))
        first = placed.filter(key.isNotNull()).agg(F.min(F.struct(key.alias("key"), "_content")).alias("at"))  # one row
        marked = placed.join(F.broadcast(first)).withColumn("_same", F.coalesce((key == F.col("at.key")) & (F.col("_content") == F.col("at._content")), F.lit(False)))
        again = marked.filter("_same").withColumn("_turn", F.row_number().over(Window.partitionBy("_content").orderBy("_content"))).filter("_turn > 1")
        df = marked.filter("NOT _same").select(*map(stats.quoted, df.columns)).unionByName(again.select(*map(stats.quoted, df.columns)))
    return df.toDF(*header)


def header_names(answer: Column) -> Column:
    """Names out of a comma-separated answer."""
    return F.transform(F.split(answer, ","), lambda name: F.trim(name))


def header_valid(df: DataFrame, answer: str, columns: str) -> DataFrame:
    """Adds the parsed names and whether there are as many as columns."""
    return df.withColumn("names", header_names(F.col(answer))).withColumn("is_valid", F.size("names") == F.col(columns))


def snake_headers(df: DataFrame) -> DataFrame:
    """Snake-case names for (table, pos, name); a name that the table has already gets the first running number that makes it new.

    Only names that are equal but for numbers at their ends can meet, so a table's names are dealt to the tasks by what is before these numbers and
    gone through there in order. A task holds the names without a new number of one such group and a count for each that is repeated."""
    named = df.withColumn("header", F.when(names.snake_name(F.col("name")) == "", "column").otherwise(names.snake_name(F.col("name"))))
    of = F.col("table").cast("string")
    dealt = named.select("table", "pos", "name", "header", of.alias("_of"), F.xxhash64(of, F.rtrim(F.col("header"), F.lit("0123456789_"))).alias("_group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plain, turns = None, set(), {}

        def seen(of: str | None, header: str) -> bool:
            before, _, number = header.rpartition("_")
            made = number.isdigit() and number[0] != "0" and 2 <= int(number) < turns.get((of, before), 2)
            return made or (of, header) in plain
        for b in batches:
            out = []
            for group, of, header in zip(b["_group"].to_pylist(), b["_of"].to_pylist(), b["header"].to_pylist()):
                if group != at:
                    at, plain, turns = group, set(), {}
                if header is None:
                    out.append(None)
                elif not seen(of, header):
                    plain.add((of, header))
                    out.append(header)
                else:
                    k = turns.get((of, header), 2)
                    while (of, f"{header}_{k}") in plain:
                        k += 1
                    turns[of, header] = k + 1
                    out.append(f"{header}_{k}")
            yield pa.RecordBatch.from_arrays([b["table"], b["pos"], b["name"], pa.array(out, pa.string())], ["table", "pos", "name", "header"])
    sorted_ = dealt.repartition("_group").sortWithinPartitions("_group", "_of", "pos", "name")
    return sorted_.mapInArrow(run, T.StructType([*df.select("table", "pos", "name").schema.fields, T.StructField("header", T.StringType())]))


def coerce(df: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """Turns text columns into numbers, or else timestamps, where more than ``share`` of all rows parse.

    One pass finds the shares (one row); the conversion itself is a projection.
    """
    facts = {r["column_name"]: r for r in stats.per_column(df, columns, {
        "total": "count(1)", "numbers": "count({v})", "times": f"count({stats.TIME_SQL})"}).collect()}
    out = {}
    for c in columns:
        f = facts[c]
        if f["total"] and f["numbers"] / f["total"] > share:
            out[c] = stats.parse_number(stats.quoted(c))
        elif f["total"] and f["times"] / f["total"] > share:
            out[c] = F.expr(stats.TIME_SQL.replace("{c}", f"`{c}`"))
    return df.withColumns(out) if out else df


def detect_header(rows: DataFrame) -> DataFrame:
    """Whether the first row of each table is a header, from (table, pos, cells).

    A header differs in kind from the rows below, or its items look like identifiers; items that all look like
    names, or common terms among them, settle it.
    """
    start = rows.groupBy("table").agg(F.min("pos").alias("first_pos"))  # one row per table
    placed = rows.join(F.broadcast(start), "table")
    first = F.col("pos") == F.col("first_pos")
    tagged = placed.select("table", "pos", "first_pos", F.posexplode("cells").alias("at", "cell"))
    below = tagged.groupBy("table", "at").agg(
        F.count_if(~first).alias("below"), (F.avg(F.when(~first, F.col("cell").rlike(stats.NUMBER).cast("double"))) > 0.5).alias("numbers_below"))
    items = tagged.filter(first).groupBy("table", "at").agg(F.max("cell").alias("item"))
    per_column = below.join(items, ["table", "at"], "left")  # one row per column each
    item = F.col("item")
    lower = F.lower(item)
    common = F.lit(False)
    for term in COMMON_TERMS:
        common = common | lower.contains(term)
    mismatch = F.col("below").cast("boolean") & (item.rlike(stats.NUMBER) != F.coalesce("numbers_below", F.lit(False)))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = per_column.groupBy("table").agg(
        share(mismatch).alias("type_mismatch"), share(item.rlike(PLAIN_SHAPES)).alias("pattern"),
        share(item.contains("_") | item.rlike("^[a-z]+[A-Z]")).alias("casing"), share(item.rlike(ITEM_SHAPE)).alias("all_names"), share(common).alias("common"))
    return out.withColumn("has_header", (F.col("type_mismatch") > 0.3) | (F.col("pattern") > 0.5) | (F.col("casing") > 0.3)
                          | (F.col("all_names") == 1.0) | (F.col("common") > 0.3))


def guess_header(rows: DataFrame) -> DataFrame:
    """Load-time guess from the first five rows of each table: the first row has more text cells than the
    average of the others. The row limit applies before the shuffle."""
    order = Window.partitionBy("table").orderBy("pos")
    head = rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    texts = F.size(F.filter("cells", lambda c: ~c.rlike(stats.NUMBER)))
    counted = head.withColumn("texts", texts).groupBy("table").agg(
        F.max(F.when(F.col("rank") == 1, F.col("texts"))).alias("first_texts"), F.avg(F.when(F.col("rank") > 1, F.col("texts"))).alias("rest_texts"))
    return counted.withColumn("is_header", F.coalesce(F.col("first_texts") > F.col("rest_texts"), F.lit(False)))


# ---- language ---------------------------------------------------------------------------------------

def _slots(text: str) -> Iterator[np.ndarray]:
    """Slots of the overlapping character trigrams of a text, in pieces of bounded size."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    for first in range(0, max(len(points) - 2, 0), PIECE):
        c = points[first:first + PIECE + 2].astype(np.int64)
        yield (c[:-2] * GRAM[0] + c[1:-1] * GRAM[1] + c[2:] * GRAM[2]) % SLOTS


def train_language_model(labelled: DataFrame, text: str, lang: str, fold: Column | None = None, folds: int = 1) -> DataFrame:
    """(fold, lang, logp): an add-one smoothed model of hashed character trigrams. ``logp`` holds, for each of `SLOTS` slots, the natural logarithm
    of the probability in millionths as a whole number, and 0 for slots that no language of the fold has.

    With ``folds`` of two or more and ``fold`` in 0 .. folds - 1, the model of a fold is trained on the rows of all other folds, so that a text
    can be labelled by a model that never saw it. Tasks count slots in arrays of fixed size; what is shuffled are at most `SLOTS` sums per task, language
    and fold, whatever the length of the texts. Rows without text or language train nothing."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for name in sorted({name for _, name in held}):
                for to in range(folds):
                    parts = [n for (f, x), n in held.items() if x == name and (folds == 1 or f != to)]
                    if parts:
                        total = np.sum(parts, axis=0)
                        at = np.flatnonzero(total)
                        yield pd.DataFrame({"fold": np.int32(to), "lang": name, "slot": at.astype(np.int32), "n": total[at]})
            held.clear()
        for b in batches:
            for f, name, value in zip(b["fold"], b["lang"], b["text"]):
                if (f, name) not in held and len(held) >= HELD:
                    yield from out()
                n = held.setdefault((f, name), np.zeros(SLOTS, np.int64))
                for slots in _slots(value):
                    n += np.bincount(slots, minlength=SLOTS)
        yield from out()

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        """One fold: at most `SLOTS` rows per language."""
        seen, names = pdf["slot"].unique(), sorted(pdf["lang"].unique())
        rows = []
        for name in names:
            own = pdf[pdf["lang"] == name]
            n = np.zeros(SLOTS, np.int64)
            n[own["slot"]] = own["n"]
            logp = np.zeros(SLOTS, np.int32)
            logp[seen] = np.round(1e6 * np.log((n[seen] + 1) / (n.sum() + SLOTS)))
            rows.append(logp)
        return pd.DataFrame({"fold": np.int32(pdf["fold"].iloc[0]), "lang": names, "logp": rows})
    rows = labelled.select((F.lit(0) if fold is None else fold).cast("int").alias("fold"), F.col(lang).cast("string").alias("lang"), F.lower(F.col(text)).alias("text"))
    counts = rows.dropna().mapInPandas(count, "fold int, lang string, slot int, n long").groupBy("fold", "lang", "slot").agg(F.sum("n").alias("n"))
    return counts.groupBy("fold").applyInPandas(dense, "fold int, lang string, logp array<int>")


def detect_language(df: DataFrame, key: str, text: str, model: DataFrame, fold: Column | None = None) -> DataFrame:
    """(key, detected, confidence): language of highest summed log probability, of equal ones the last by name; texts under three characters
    (and texts without a known trigram) count as English with 0.5.

    Nothing is shuffled: the model has a fixed size per fold and language and goes to the tasks, which score row by row. More than
    `MODELS` of them are refused, since the column is then hardly one of languages."""
    rows = model.limit(MODELS + 1).collect()
    if len(rows) > MODELS:
        raise ValueError(f"over {MODELS} languages and folds in the model")
    by_fold = {}
    for r in sorted(rows, key=lambda r: r["lang"], reverse=True):
        by_fold.setdefault(r["fold"], []).append((r["lang"], np.array(r["logp"], np.int32)))
    tables = {f: ([name for name, _ in own], np.stack([p for _, p in own])) for f, own in by_fold.items()}

    @F.pandas_udf("string")
    def best(texts: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for value, f in zip(texts, at):
            names, table = tables.get(f, ([], None))
            score, known = np.zeros(len(names), np.int64), False
            for slots in _slots(value or "") if names else ():
                part = table[:, slots].sum(axis=1, dtype=np.int64)
                score, known = score + part, known or bool(table[:, slots].any())
            out.append(names[int(score.argmax())] if known else None)
        return pd.Series(out, dtype=object)
    found = df.select(key, F.length(F.trim(F.col(text))).alias("_len"), best(F.lower(F.col(text)), (F.lit(0) if fold is None else fold).cast("int")).alias("_best"))
    known = (F.col("_len") >= 3) & F.col("_best").isNotNull()
    return found.select(key, F.when(known, F.col("_best")).otherwise("en").alias("detected"), F.when(known, 0.8).otherwise(0.5).alias("confidence"))


def language_mismatches(df: DataFrame, text: str, detected: str, target: str, least: int = 4) -> DataFrame:
    """Per table: headers not in the target language and those of under ``least`` characters, too short to tell, as counts and a verdict.
    With ``least`` of 0 every text counts by its detected language, missing ones too."""
    named = language.match_languages(df, detected, target, "_same")
    short = F.coalesce(F.length(text) < least, F.lit(least > 0))
    return named.groupBy("table").agg(F.count_if(short).alias("too_short"), F.count_if(~short & ~F.col("_same")).alias("mismatches")).withColumn(
        "is_in_target_language", F.col("mismatches") == 0)


def resolve_language(df: DataFrame, metadata: str, from_name: str, header: str) -> DataFrame:
    """Language by metadata (1.0), else by file name (0.8), else English (0.5); compared with the header's."""
    rows = df.withColumns({
        "language": F.coalesce(F.nullif(F.col(metadata), F.lit("")), F.nullif(F.col(from_name), F.lit("")), F.lit("en")),
        "confidence": F.when(F.nullif(F.col(metadata), F.lit("")).isNotNull(), 1.0).when(F.nullif(F.col(from_name), F.lit("")).isNotNull(), 0.8).otherwise(0.5)})
    return language.match_languages(rows, "language", header, "is_match")


def translate_headers(headers: DataFrame, terms: DataFrame) -> DataFrame:
    """Translates (table, names) by a term table (term, translation); unknown names stay, order and length too."""
    items = headers.select("table", F.posexplode("names").alias("at", "name"))
    once = terms.groupBy(F.col("term").alias("name")).agg(F.min("translation").alias("translation"))
    done = items.join(once, "name", "left").withColumn("out", F.coalesce("translation", "name"))
    return done.groupBy("table").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]).alias("names"))
