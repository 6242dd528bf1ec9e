"""CSV tables: parts by name, records over byte ranges, bad lines, delimiters."""

import csv as plain_csv
import io
import random

import pytest

from colonnade.sources import csv


@pytest.fixture
def small_ranges(spark):
    """Files are cut every 64 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_parts_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,age\n1,ann,30\n")
    (tmp_path / "b.csv").write_text("age,id,name\n40,2,bob\n")
    df = csv.read_csv_table(spark, str(tmp_path))
    assert rows_of(df.select("id", "name", "age")) == [(1, "ann", 30), (2, "bob", 40)] and dict(df.dtypes) == {"id": "int", "name": "string", "age": "int"}


def test_charsets_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,when\n1,2020-01-02\n")
    (tmp_path / "b.csv").write_bytes("id,name\n2,café\n".encode("latin-1"))
    df = csv.read_csv_table(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "int", "when": "date", "name": "string"}
    assert [(r["id"], str(r["when"]), r["name"]) for r in df.orderBy("id").collect()] == [(1, "2020-01-02", None), (2, "None", "café")]
    given = csv.read_csv_table(spark, str(tmp_path), schema="name string, id bigint")
    assert given.columns == ["name", "id"]
    assert rows_of(csv.read_csv_table(spark, str(tmp_path / "a.csv"), schema="x bigint, y string")) == [(1, "2020-01-02")]  # other names: by position


def cells(r):
    return "".join(r.choice(["a", "bc", " ", "\n", "\n\n", "\r\n", '"', '""', ",", "é", "x" * 30, "7"]) for _ in range(r.randint(0, 9)))


@pytest.mark.parametrize("seed", [1, 2])
def test_records_over_ranges_equal_a_plain_reader(spark, tmp_path, small_ranges, seed):
    r, want = random.Random(seed), []
    for part in range(2):
        out = io.StringIO()
        write = plain_csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=plain_csv.QUOTE_MINIMAL)
        names = ["k", "t", "u"] if part else ["u", "k", "t"]
        write.writerow(names)
        for i in range(40):
            row = {"k": str(part * 100 + i), "t": cells(r), "u": cells(r)}
            write.writerow([row[n] for n in names])
            want.append((int(row["k"]), row["t"] or None, row["u"] or None))
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    df = csv.read_csv_table(spark, str(tmp_path), ",", overrides={"t": "string", "u": "string"})
    raw = csv.raw_lines(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() > 20 and csv.quote_ranges(raw, ",").crossing()
    assert rows_of(df.select("k", "t", "u")) == sorted(want, key=str)


def test_one_long_cell_and_an_open_quote(spark, tmp_path, small_ranges):
    long = "line of text\n" * 60
    (tmp_path / "a.csv").write_text(f'id,t\n1,"{long}"\n2,x\n3,5" pipe\n4,"y"\n')
    assert rows_of(csv.read_csv_table(spark, str(tmp_path))) == [(1, long), (2, "x"), (3, '5" pipe'), (4, "y")]
    (tmp_path / "b.csv").write_text('id,t\n5,z\n6,"never closed\n7,q\n')
    assert rows_of(csv.read_csv_table(spark, str(tmp_path / "b.csv"))) == [(5, "z"), (6, "never closed\n7,q")]


def test_ranges_that_change_are_noticed(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("id,t\n" + '1,"two\nlines"\n' * 30)
    raw = csv.raw_lines(spark, str(tmp_path))
    ranges = csv.quote_ranges(raw, ",")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    with pytest.raises(Exception, match="changed between two reads"):
        csv._pieces(csv.raw_lines(spark, str(tmp_path)), ",", ranges).collect()


@pytest.mark.parametrize("line, inside, want", [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('"a""', False, True), ('a"b,c', False, False),
                                                ('""', True, True), ('","', False, False), ('","', True, True), ("", True, True), ('"a"b,"c', False, True)])
def test_quotes(line, inside, want):
    assert csv.ends_in_quotes(line, inside, ",") is want


def test_bad_lines_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid,t,t\n1,"x ""y""\nz",2\n\n  \n2,short\n3,a,b,c\nx,a,b\n')
    df = csv.read_csv_table(spark, str(tmp_path), schema="id int, t1 string, t2 string", bad="_line")
    assert df.columns == ["id", "t1", "t2", "_line"]
    assert rows_of(df.filter("_line IS NULL").drop("_line")) == [(1, 'x "y"\nz', "2")]
    assert {r["_line"] for r in df.filter("_line IS NOT NULL").collect()} == {"2,short", "3,a,b,c", "x,a,b"}
    good, bad = csv.split_bad_lines(spark, str(tmp_path), df.drop("_line").schema)
    assert good.count() == 1 and bad.count() == 3
    assert csv.read_csv_table(spark, str(tmp_path), ",", header=False).columns == ["_c0", "_c1", "_c2"]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("")
    assert csv.read_csv_table(spark, str(tmp_path / "e"), ",").count() == 0


def test_marks_in_quotes_do_not_count(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a,b,c,d,e";n\nx;1\ny;2\n')
    assert csv.delimiter_by_header(csv.head_lines(spark, str(tmp_path))).first()["delimiter"] == ";"
    (tmp_path / "b.csv").write_text('name,"a,b"\n"1,2,3",4\n"5,6,7",8\n')
    assert csv.has_header(csv.head_lines(spark, str(tmp_path / "b.csv")), ",")
