import csv as plain_csv
import random

import pytest

from tablewright.sources import csv, records, sinks
from tablewright.sources.staging import shared_folder, spread, stage


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_delimiter_is_found(spark, tmp_path, separator):
    text = f"a{separator}b\n\"x, y; z\"{separator}1\n\"p|q\"{separator}2\n"
    path = put(tmp_path, "t.txt", text)
    assert csv.sniff_delimiter(spark, path) == separator
    assert [tuple(r) for r in csv.load_table(spark, path).collect()] == [("x, y; z", 1), ("p|q", 2)]


def test_single_column_file_falls_back_to_comma(spark, tmp_path):
    assert csv.sniff_delimiter(spark, put(tmp_path, "t.csv", "a\n1\n2\n")) == ","


def test_encodings(spark, tmp_path):
    latin = put(tmp_path, "l.csv", "name,n\nZoé,1\n", "latin-1")
    assert csv.detect_encoding(spark, latin) == "ISO-8859-1" and csv.load_table(spark, latin).first()["name"] == "Zoé"
    bom = put(tmp_path, "b.csv", "﻿name,n\nZoé,1\n")
    assert csv.load_table(spark, bom).columns == ["name", "n"]


def test_null_tokens_and_types(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'i,d,b,s,q\n1,1.5,true,NA,"a\nb"\n2,,False,x,"say ""hi"""\n')
    df = csv.load_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, None, "a\nb"), (2, None, False, "x", 'say "hi"')]


def test_unreadable_sources(spark, tmp_path):
    with pytest.raises(csv.SourceError):
        csv.load_table(spark, str(tmp_path / "nothing.csv"))
    with pytest.raises(csv.SourceError):
        csv.load_table(spark, "book.xlsx")


def test_load_status_and_metadata(spark, tmp_path):
    header_only = csv.load_table(spark, put(tmp_path, "h.csv", "a,b\n"))
    status = csv.load_status(header_only).first()
    assert (status["success"], status["columns"]) == (False, 2) and "no data rows" in status["error_message"]
    path = put(tmp_path, "m.csv", "a,b\n1,\n1,\n2,x\n")
    row = csv.load_metadata(csv.load_table(spark, path), path).first()
    assert (row["rows"], row["columns"], row["initial_missing_count"], row["initial_duplicate_count"]) == (3, 2, 2, 1)
    assert row["file_size_kb"] == 0.01 and row["column_names"] == ["a", "b"]


def test_csv_round_trip_keeps_blanks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'q"x'), ("b\nc", None)], "x string, y string")
    path = sinks.write_table(df, str(tmp_path / "out"))
    assert sorted(map(tuple, csv.read_delimited(spark, path, ",").collect())) == [(" a ", 'q"x'), ("b\nc", None)]
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "other"), "xls")


def test_sheet_projection(spark):
    df = spark.sql("select id, if(id = 0, repeat('x', 32001), null) as t, array(1, 2) as a, timestamp '2026-01-01' as ts from range(3)")
    rows = sinks.sanitize_for_sheet(df, ["id"], max_rows=2, max_chars=sinks.MAX_CELL_CHARS).collect()
    assert len(rows) == 2 and rows[0]["t"] == "x" * 32000 + "... [truncated]" and rows[1]["t"] == "" and rows[0]["a"] == "[1,2]"
    assert sinks.as_text(df).dtypes == [("id", "string"), ("t", "string"), ("a", "string"), ("ts", "string")]


def test_sheet_without_limits_loses_nothing(spark):
    whole = sinks.sanitize_for_sheet(spark.range(5).selectExpr("id", "repeat('x', 40000) as t")).collect()
    assert sorted(r["id"] for r in whole) == [0, 1, 2, 3, 4] and all(len(r["t"]) == 40000 for r in whole)


def test_separator_is_decided_from_the_whole_file(spark, tmp_path):
    lines = ["id;last,first"] + [f"{i};Doe,Jo" for i in range(250)] + [f"{i};Smith" for i in range(9000)]
    assert csv.sniff_delimiter(spark, put(tmp_path, "late.csv", "\n".join(lines) + "\n")) == ";"


def test_number_literals_that_are_not_finite(spark):
    from tablewright.functions.sql import number

    row = spark.sql(f"select {number(float('nan'))} as a, {number(float('inf'))} as b, {number(float('-inf'))} as c").first()
    assert row.a != row.a and row.b == float("inf") and row.c == float("-inf")


def test_staging(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string").toDF("odd, name", "it;em")
    again = stage(df)
    assert again.columns == df.columns and again.collect() == df.collect()
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_surplus_fields_and_other_headers_are_errors(spark, tmp_path):
    for rows in ("1,2\n3,4,5\n", '1,2\n"x,y",4,,5\n'):
        with pytest.raises(csv.SourceError):
            csv.read_delimited(spark, put(tmp_path, "s.csv", "a,b\n" + rows), ",")
    fine = put(tmp_path, "f.csv", 'a,b\n"x,y","1\n2"\n3\n5,6,\n')
    assert sorted(map(tuple, csv.read_delimited(spark, fine, ",").collect())) == [("3", None), ("5", "6"), ("x,y", "1\n2")]


def test_files_are_matched_by_their_headers(spark, tmp_path):
    for name, header in (("same", "a,b"), ("turned", "b,a"), ("other", "b,c"), ("turned twice", '"b",a')):
        folder = tmp_path / name
        folder.mkdir()
        put(folder, "1 st.csv", "a,b\n1,2\n")
        put(folder, "2.csv", header + "\r\n3,4\r\n")
    assert sorted(map(tuple, csv.read_delimited(spark, str(tmp_path / "same"), ",").collect())) == [("1", "2"), ("3", "4")]
    for name in ("turned", "turned twice"):
        assert sorted(map(tuple, csv.read_delimited(spark, str(tmp_path / name), ",").collect())) == [("1", "2"), ("4", "3")]
    with pytest.raises(csv.SourceError, match="2.csv"):
        csv.read_delimited(spark, str(tmp_path / "other"), ",")
    put(tmp_path / "turned", "3.csv", 'b,a\n"x\ny",5\n')
    assert sorted(map(tuple, csv.read_delimited(spark, str(tmp_path / "turned"), ",").collect())) == [("1", "2"), ("4", "3"), ("5", "x\ny")]
    put(tmp_path / "turned", "4.csv", 'b,a\n"x\ny",5,6\n')
    with pytest.raises(csv.SourceError, match="4.csv"):
        csv.read_delimited(spark, str(tmp_path / "turned"), ",")


def _quoted_rows(seed, n):
    draw = random.Random(seed)
    bits = ["a", "bc", " ", ",", ";", '"', '""', "\n", "\n\n", "é", "'", "x" * 40]
    return [["".join(draw.choice(bits) for _ in range(draw.randrange(1, 9))) + "." for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
@pytest.mark.parametrize(("ending", "split"), [("\n", 64), ("\r\n", 997), ("\n", 1 << 20)])
def test_records_that_cross_splits(spark, tmp_path, encoding, ending, split):
    """Splits of a few bytes begin and end inside quotes, some lie wholly inside a field."""
    rows = _quoted_rows(split, 40) + [["long", "y\n" * 200, 'plain 5" pipe']]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        with open(folder / f"{k}.csv", "w", encoding=encoding, newline="") as out:
            writer = plain_csv.writer(out, lineterminator=ending)
            writer.writerows([["p", "q", "r"], *rows[k::3]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = csv.read_delimited(spark, str(folder))
        assert found.columns == ["p", "q", "r"]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_quote_counts_only_where_a_field_begins(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'size,n\n5" pipe,1\n6" pipe,2\n"a ""b"" c",3\n')
    assert sorted(map(tuple, csv.read_delimited(spark, path).collect())) == [('5" pipe', "1"), ('6" pipe', "2"), ('a "b" c', "3")]
    after = records._line_reader(",")
    assert [after(x, False) for x in ('5" pipe,1', '"open', 'a,"open, still', '"a""', '"a"', 'a"b,"c"', '"a"x"y,"z')] == [False, True, True, True, False, False, True]
    assert [after(x, True) for x in ("still", 'done"', 'done",a', 'done","again', 'a""b', 'a""b"c,"d"')] == [True, False, False, True, True, False]


def test_one_pass_over_the_source(spark, tmp_path):
    """Plain lines are read by the splittable reader; nothing asks for whole files."""
    path = put(tmp_path, "plain.csv", "a,b\n" + "".join(f"{i},x{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = csv.read_delimited(spark, path)
        assert found.rdd.getNumPartitions() > 8 and found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
