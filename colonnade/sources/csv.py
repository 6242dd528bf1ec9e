"""CSV tables: delimiter, character set, header, bad lines, folders of tables."""

from __future__ import annotations

import csv as plain_csv
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators import header as header_rules
from colonnade.session import stage

# Candidate delimiters, in order of preference.
CANDIDATES = [",", ";", "\t", "|"]
HEAD_LINES = 50
QUOTED = '"[^"]*("|$)'


def head_lines(spark: SparkSession, paths: list[str] | str, lines: int = HEAD_LINES) -> DataFrame:
    """(path, line_no, value): the first lines of each file, taken from its first block only."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(paths)
    first = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value").filter("start = 0")
    numbered = first.withColumn("at", F.monotonically_increasing_id())
    order = Window.partitionBy("path").orderBy("at")
    return numbered.withColumn("line_no", F.row_number().over(order)).filter(F.col("line_no") <= lines).select("path", "line_no", "value")


def _hits(value: Column, mark: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(mark), F.lit("")))


def delimiter_by_width(heads: DataFrame) -> DataFrame:
    """(path, delimiter): the delimiter with the fewest columns that still gives more than one; comma otherwise.

    All head lines count, without what stands in quotes (which may go over several lines); a delimiter that gives some
    line more columns than the first does not fit.
    """
    joined = heads.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("text"))
    lines = joined.select("path", F.filter(F.split(F.regexp_replace("text", QUOTED, ""), "\n"), lambda v: v != "").alias("lines"))
    options = []

    def widths_of(mark: str) -> Column:
        return F.transform("lines", lambda v: _hits(v, mark) + 1)
    for i, d in enumerate(CANDIDATES):
        widths = widths_of(d)
        fits = (F.get(widths, 0) > 1) & (F.array_max(widths) == F.get(widths, 0))
        options.append(F.when(fits, F.struct(F.get(widths, 0).alias("width"), F.lit(i).alias("at"), F.lit(d).alias("d"))))
    best = F.array_min(F.array(*options))
    return lines.select("path", F.coalesce(best["d"], F.lit(",")).alias("delimiter"))


def delimiter_by_header(heads: DataFrame) -> DataFrame:
    """(path, delimiter): the delimiter with most hits outside quotes in the first line; comma when none occurs."""
    first = heads.groupBy("path").agg(F.min_by("value", "line_no").alias("value"))
    options = F.array(*[F.struct(_hits(F.regexp_replace("value", QUOTED, ""), d).alias("hits"), F.lit(-i).alias("at"), F.lit(d).alias("d")) for i, d in enumerate(CANDIDATES)])
    best = F.array_max(options)
    return first.select("path", F.when(best["hits"] > 0, best["d"]).otherwise(",").alias("delimiter"))


def file_charsets(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, charset): utf-8 where every line is valid, latin-1 otherwise (it decodes any byte).

    Lines are checked as raw bytes in splits, so a large file is not read by one task.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(paths)
    checked = raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"))
    return checked.select("path", F.when(F.col("ok"), "utf-8").otherwise("iso-8859-1").alias("charset"))


# Cells may hold the delimiter, doubled quotes, line breaks and blanks at their ends.
CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# Types in the order in which one takes in the other; date goes into timestamp; any other pair of types becomes text.
WIDER = ["int", "bigint", "double"]


def _wider(a: str, b: str) -> str:
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if {a, b} == {"date", "timestamp"}:
        return "timestamp"
    return max(a, b, key=WIDER.index) if a in WIDER and b in WIDER else "string"


def has_header(heads: DataFrame, sep: str) -> bool:
    """Guess for the first file that has more than one line: its first line against the next four. A part without rows tells nothing."""
    first = heads.filter("line_no > 1").agg(F.min("path").alias("first"))  # one row
    rows = heads.join(F.broadcast(first), heads["path"] == F.col("first")).select(
        F.col("path").alias("table"), F.col("line_no").alias("pos"), F.split("value", "\\Q" + sep + "\\E" + '(?=(?:[^"]*"[^"]*")*[^"]*$)').alias("cells"))  # marks in quotes part no cells
    row = header_rules.guess_header(rows).first()
    return bool(row and row["is_header"])


# ---- records of split files -------------------------------------------------------------------------

def ends_in_quotes(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins in or outside quotes ends inside them. A quote opens a cell only at its start, two quotes in a cell
    stand for one, and what follows a closing quote up to the delimiter is plain."""
    at = 0
    if not inside:
        inside, at = line.startswith('"'), 1
        if not inside:
            at = 0
    while True:
        if inside:
            end = line.find('"', at)
            while end >= 0 and line.startswith('"', end + 1):
                end = line.find('"', end + 2)
            if end < 0:
                return True
            inside, at = False, end + 1
        while not inside:
            next_ = line.find(sep, at)
            if next_ < 0:
                return False
            at = next_ + len(sep)
            if line.startswith('"', at):
                inside, at = True, at + 1


def raw_lines(spark: SparkSession, paths: list[str] | str, charset: str = "utf-8", pattern: str = "*.csv") -> DataFrame:
    """(path, start, value): the lines of every file by byte range, in their order within a range; start is the range's first byte.

    Only line feeds end a line, so a carriage return stays with it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(paths)
    value = F.col("value") if charset.lower() in ("utf-8", "us-ascii") else F.decode(F.col("value").cast("binary"), charset)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), value.alias("value"))


class Ranges:
    """For each byte range of the files that has quotes: how it ends if it begins outside or inside quotes, and how it does begin."""

    def __init__(self, rows: list[tuple[str, int, bool, bool]]):
        self.ends: dict[tuple[str, int], bool] = {}
        self.starts: dict[str, list[int]] = {}
        for path, start, outside, inside in sorted(rows):
            self.ends[path, start] = inside if self.begins(path, start) else outside
            self.starts.setdefault(path, []).append(start)

    def begins(self, path: str, start: int) -> bool:
        """Whether a range begins inside quotes: as the last range with quotes before it ends."""
        before = self.starts.get(path, [])
        at = bisect_left(before, start)
        return bool(at) and self.ends[path, before[at - 1]]

    def crossing(self) -> list[tuple[str, int, int]]:
        """(path, first range, last range) of the stretches that a quoted cell crosses: from the range in which it opens on."""
        out = []
        for path, starts in self.starts.items():
            for here, next_ in zip(starts, [*starts[1:], 1 << 62]):
                if self.ends[path, here]:
                    out.append((path, here, next_))
        return out


def quote_ranges(raw: DataFrame, sep: str) -> Ranges:
    """How quotes run through the ranges. Tasks look at the lines with quotes only, from both possible beginnings; the driver gets two flags for each
    range that has quotes and puts the ranges of a file in line."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[tuple[str, int], list[bool]] = {}
        for t in batches:
            for path, start, line in zip(t["path"], t["start"], t["value"]):
                ends = out.setdefault((path, start), [False, True])
                ends[:] = [ends_in_quotes(line, inside, sep) for inside in ends]
        yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["path", "start", "outside", "inside"])
    quoted = raw.filter(F.contains("value", F.lit('"'))).mapInPandas(run, "path string, start long, outside boolean, inside boolean")
    return Ranges([tuple(r) for r in quoted.collect()])


WHOLE, OPENED, GOES_ON = 0, 1, 2


def _pieces(raw: DataFrame, sep: str, ranges: Ranges) -> DataFrame:
    """(path, start, no, part, value): whole records of each range, the record that is open at its end, and what belongs to one opened before."""
    known = raw.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, at, inside, part, held, no, quotes = known.value, None, False, WHOLE, [], 0, False
        out: list[tuple] = []

        def close(part: int) -> None:
            nonlocal no
            out.append((*at, no, part, "\n".join(held)))
            no += 1
            held.clear()

        def leave() -> None:
            # ranges are cut anew by each read: a read that cuts otherwise must not go on
            if quotes and ranges.ends.get(at) is not inside:
                raise ValueError(f"the byte ranges of {at[0]} changed between two reads; read again")
            if held:
                close(GOES_ON if part == GOES_ON else OPENED)
        for t in batches:
            for path, start, line in zip(t["path"], t["start"], t["value"]):
                if (path, start) != at:
                    if at:
                        leave()
                    at, inside, no, quotes = (path, start), ranges.begins(path, start), 0, False
                    part = GOES_ON if inside else WHOLE
                if '"' in line:
                    inside, quotes = ends_in_quotes(line, inside, sep), True
                held.append(line)
                if not inside:
                    close(part)
                    part = WHOLE
            yield pd.DataFrame(out, columns=["path", "start", "no", "part", "value"])
            out = []
        if at:
            leave()
        yield pd.DataFrame(out, columns=["path", "start", "no", "part", "value"])
    return raw.mapInPandas(run, "path string, start long, no long, part int, value string")


def records(raw: DataFrame, sep: str) -> DataFrame:
    """(path, start, no, value): one row per CSV record of `raw_lines`, in as many tasks as the files have byte ranges.

    Every task knows from `quote_ranges` whether its range begins inside a quoted cell. Records that cross ranges are put together from
    their pieces, which only the ranges concerned are read for once more. A quote that is never closed makes the rest of its file one record."""
    ranges = quote_ranges(raw, sep)
    keep = ["path", "start", "no", F.regexp_replace("value", "\r$", "").alias("value")]
    out = _pieces(raw, sep, ranges).filter(F.col("part") == WHOLE).select(*keep)
    crossing = ranges.crossing()
    if not crossing:
        return out
    wanted = raw.sparkSession.createDataFrame(crossing, "path string, first long, last long")  # one row per range at most
    near = raw.join(F.broadcast(wanted.withColumnRenamed("path", "of")), (F.col("path") == F.col("of")) & F.col("start").between(F.col("first"), F.col("last")), "left_semi")
    parts = _pieces(near, sep, ranges).filter(F.col("part") != WHOLE)
    order = Window.partitionBy("path").orderBy("start", "no")  # two pieces per range at most
    numbered = parts.withColumn("record", F.count_if(F.col("part") == OPENED).over(order))
    piece = F.struct("start", "no", "value")
    joined = numbered.groupBy("path", "record").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    whole = joined.select("path", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["no"].alias("no"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return out.unionByName(whole.select(*keep))


def file_facts(spark: SparkSession, paths: list[str] | str, pattern: str = "*.csv") -> DataFrame:
    """(path, charset, head): character set and first line of every file, from one scan."""
    raw = raw_lines(spark, paths, pattern=pattern).withColumn("at", F.monotonically_increasing_id())
    first = F.min(F.when(F.col("start") == 0, F.struct("at", "value")))["value"]
    facts = raw.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"), first.cast("binary").alias("head"))
    charset = F.when(F.col("ok"), "utf-8").otherwise("iso-8859-1")
    decoded = F.when(F.col("ok"), F.decode("head", "utf-8")).otherwise(F.decode("head", "iso-8859-1"))
    return facts.select("path", charset.alias("charset"), F.regexp_replace(F.regexp_replace(decoded, "\r$", ""), "^\ufeff", "").alias("head"))


def _names(head: str, sep: str, header: bool) -> list[str]:
    """Column names from a header line: empty ones are numbered, repeated ones get their number; without header all are numbered."""
    cells = next(plain_csv.reader([head], delimiter=sep), [])
    if not header:
        return [f"_c{i}" for i in range(len(cells))]
    return [f"_c{i}" if not c else f"{c}{i}" if cells.count(c) > 1 else c for i, c in enumerate(cells)]


# The parser drops or stops at these characters (a byte order mark where it begins a record), so they are spelled otherwise while it runs. No cell can
# hold NOTHING then, which stands for a cell without text and without quotes.
SPELLED = [("\ufffe", "\ufffe0"), ("\uffff", "\ufffe1"), ("\x00", "\ufffe2"), ("\ufeff", "\ufffe3")]
NOTHING = "\ufffen"


def _spelled(value: Column) -> Column:
    out = value
    for mark, spelling in SPELLED:
        out = F.replace(out, F.lit(mark), F.lit(spelling))
    found = F.contains(value, F.lit("\ufffe")) | F.contains(value, F.lit("\uffff")) | F.contains(value, F.lit("\x00")) | F.startswith(value, F.lit("\ufeff"))
    return F.when(found, out).otherwise(value)


def _unspelled(value: Column) -> Column:
    out = value
    for mark, spelling in reversed(SPELLED):
        out = F.replace(out, F.lit(spelling), F.lit(mark))
    return F.when(F.contains(value, F.lit("\ufffe")), out).otherwise(value)


def _parsed(rows: DataFrame, names: list[str], types: dict[str, str], sep: str, bad: str | None) -> DataFrame:
    """Cells of records, by position in their file, under the names of its header; `bad` takes records that do not fit. Empty quotes are an
    empty text, a cell without them is missing; in columns that are no texts both are missing."""
    kinds = ", ".join([*[f"c{i} {types.get(n, 'string')}" for i, n in enumerate(names)], "_bad string"])
    options = {**CELLS, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
    value = _spelled(F.col("value"))
    parsed = [F.from_csv(value, kinds, {**options, "nullValue": NOTHING}).alias("r")]
    if bad:
        parsed.append(F.from_csv(value, kinds, options)["_bad"].alias("_bad"))  # empty quotes are no fault in a number
    cells = rows.select(*parsed)
    columns = [(_unspelled(F.col(f"r.c{i}")) if types.get(n, "string") == "string" else F.col(f"r.c{i}")).alias(n) for i, n in enumerate(names)]
    return cells.select(*columns, *([_unspelled(F.col("_bad")).alias(bad)] if bad else []))


NUMBER_CELL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^NaN$|^[+-]?Inf$"
DATE_CELL = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME_CELL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def _types(cells: DataFrame) -> dict[str, str]:
    """Narrowest type that holds all cells of each column but missing and empty ones, from one aggregate; the driver gets one row."""
    fits = {"int": lambda c: c.rlike("^[+-]?[0-9]+$") & c.try_cast("int").isNotNull(), "bigint": lambda c: c.rlike("^[+-]?[0-9]+$") & c.try_cast("bigint").isNotNull(),
            "double": lambda c: c.rlike(NUMBER_CELL), "boolean": lambda c: F.lower(c).isin("true", "false"),
            "date": lambda c: c.rlike(DATE_CELL) & c.try_cast("date").isNotNull(), "timestamp": lambda c: c.rlike(f"{DATE_CELL}|{TIME_CELL}") & c.try_cast("timestamp").isNotNull()}
    columns = [F.nullif(F.col(f"`{n.replace('`', '``')}`"), F.lit("")) for n in cells.columns]
    tests = [F.coalesce(F.bool_and(F.when(c.isNotNull(), fit(c))), F.lit(True)).alias(f"{i}{kind}") for i, c in enumerate(columns) for kind, fit in fits.items()]
    row = cells.agg(*tests, *[F.count(c).alias(f"{i}n") for i, c in enumerate(columns)]).first()
    return {n: next((k for k in fits if row[f"{i}{k}"]), "string") if row[f"{i}n"] else "void" for i, n in enumerate(cells.columns)}


def read_csv_table(spark: SparkSession, path: str | list[str], sep: str | None = None, header: bool | None = True, encoding: str | None = None,
                   schema: T.StructType | str | None = None, overrides: dict[str, str] | None = None, bad: str | None = None, pattern: str = "*.csv") -> DataFrame:
    """One CSV table, given as a file or a folder of parts. Delimiter, character sets and (for None) the header are detected
    where not given. Every part is read by its own header line, whatever the order of its columns; columns that a part lacks are null in its
    rows. Types are inferred once over all parts; those in ``overrides`` replace the inferred ones before the data are read, so that
    01234 stays what it is as text. With a ``schema`` its columns are found by name where all headers have them, by position otherwise.

    Cells may hold line breaks: a file is read in as many tasks as it has byte ranges all the same, see ``records``. ``bad`` names a further
    column for records that do not fit; ``pattern`` chooses files by their names. Character sets that are no superset of ASCII (UTF-16) are not read."""
    if sep is None or header is None:
        heads = head_lines(spark, path)
        if sep is None:
            row = delimiter_by_width(heads).orderBy("path").first()
            sep = row["delimiter"] if row else ","
        header = has_header(heads, sep) if header is None else header
    groups = file_facts(spark, path, pattern).withColumn("charset", F.lit(encoding) if encoding else F.col("charset")).withColumn("head", F.col("head") if header else F.lit(None)).groupBy(
        "charset", "head").agg(F.collect_list("path").alias("paths"), F.first("head").alias("first")).orderBy("charset", "head").collect()  # paths, as Spark lists them
    if not header:
        widest = file_facts(spark, path, pattern).agg(F.max_by("head", F.size(F.split("head", F.lit("\\Q" + sep + "\\E"))))).first()[0] or ""
    parts = []
    for g in groups:
        raw = raw_lines(spark, path if len(groups) == 1 else g["paths"], g["charset"], pattern)
        rows = records(raw, sep)
        at_start = (F.col("start") == 0) & (F.col("no") == 0)
        if header:
            rows = rows.filter(~at_start)
        else:
            rows = rows.withColumn("value", F.when(at_start, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
        parts.append((rows.filter(F.trim("value") != ""), _names(g["head"] if header else widest, sep, header)))
    if schema is None:
        types: dict[str, str] = {}
        for rows, names in parts:
            for name, kind in _types(_parsed(rows, names, {}, sep, None)).items():
                types[name] = _wider(types.get(name, "void"), kind)
        types = {n: (overrides or {}).get(n, "string" if k == "void" else k) for n, k in types.items()}
        wanted = list(types)
    else:
        fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
        types = {f.name: (overrides or {}).get(f.name, f.dataType.simpleString()) for f in fields}
        wanted = list(types)
        if not header or not all(set(wanted) <= set(names) for _, names in parts):
            parts = [(rows, wanted) for rows, _ in parts]
    out = None
    for rows, names in parts:
        part = _parsed(rows, names, types, sep, bad)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in [*types.items(), *([(bad, "string")] if bad else [])]) or "_c0 string")
    return out.select(*[F.col(f"`{n.replace('`', '``')}`") for n in wanted], *([bad] if bad else []))


def split_bad_lines(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): records that do not fit the schema are set apart instead of ending the read. Quoted line breaks and doubled quotes fit."""
    rows = stage(read_csv_table(spark, path, sep, header, schema=schema, bad="_bad", pattern="*"), "csv_rows")  # parsed once for both results
    good = rows.filter("_bad IS NULL").drop("_bad")
    return good, rows.filter("_bad IS NOT NULL").select(F.col("_bad").alias("line"))


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, table, path, bytes) of every CSV below ``root``: the first folder is the dataset, the next part
    (a file's stem or a table's folder) the table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
    inside = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/").split("/")[-1] + "/", -1), r"\.csv$", "")
    parts = F.split(inside, "/")
    return files.select(parts[0].alias("dataset"), parts[1].alias("table"), F.concat_ws("__", parts[0], parts[1]).alias("key"), "path", F.col("length").alias("bytes"))


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").options(**CELLS).option("sep", sep).option("header", True).option("encoding", encoding).csv(path)
