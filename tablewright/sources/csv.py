"""Delimited-text source: delimiter and encoding detection, null tokens, type inference."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numbers import looks_numeric, round_scalar
from tablewright.functions.sql import any_of, q, replace_columns, rows_of, text, text_columns
from tablewright.operators.dedup import duplicate_count
from tablewright.operators.entry import finite, finite_value
from tablewright.sources.records import decoded, ends_inside, fields_of, lines_of, records_of
from tablewright.sources.staging import stage

# Text a delimited file uses for "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# Separators tried, in order of preference.
SEPARATORS = (",", ";", "\t", "|")
EXCEL_SUFFIXES = (".xlsx", ".xls", ".xlsm")
_INTEGER = r"^[+-]?\d{1,18}$"


class SourceError(Exception):
    """The input cannot be read as a table."""


@dataclass(frozen=True)
class Scan:
    """What one pass over all lines has found: votes for separators, valid text, records that may cross lines."""

    facts: DataFrame  # file, place (of the separator), n (separators on a line), lines, fields, opens, invalid

    def encoding(self) -> str:
        """UTF-8 unless some line is no valid UTF-8, then ISO-8859-1."""
        return "UTF-8" if self.facts.where("invalid").isEmpty() else "ISO-8859-1"

    def delimiter(self) -> str:
        """Separator with the same non-zero count on the most lines; `,` if none."""
        counts = self.facts.groupBy("place", "n").agg(F.sum("lines").alias("lines"))
        usual = counts.groupBy("place").agg(F.max(F.struct("lines", "n")).alias("top")).select("place", "top.*")
        scored = [(row["lines"], -row["place"]) for row in usual.collect() if row["n"]]
        return SEPARATORS[-max(scored)[1]] if scored else ","


def scan(spark: SparkSession, path: str, separators: Sequence[str] = SEPARATORS) -> Scan:
    """One pass over the lines, split as any text; what is kept is a few rows a file."""
    lines = lines_of(spark, path).selectExpr("file", "not is_valid_utf8(value) as invalid", "regexp_replace(value, '\\r$', '') as line").where("length(line) > 0")
    lines = lines.selectExpr("file", "line", "invalid", "contains(line, '\"') as quoted").selectExpr(
        "*", """if(quoted, regexp_replace(line, '"[^"]*"', ''), line) as bare""")
    votes = lines.selectExpr("file", "invalid", rows_of(
        f"struct({i} as place, length(bare) - length(replace(bare, {text(s)}, '')) as n, {fields_of('line', s)} as fields, "
        f"if(quoted, line rlike {text(ends_inside(s))}, false) as opens)" for i, s in enumerate(separators)))
    return Scan(stage(votes.groupBy("file", "place", "n").agg(
        F.expr("count(1) as lines"), F.expr("max(fields) as fields"), F.expr("max(opens) as opens"), F.expr("max(invalid) as invalid")), "csv-scan"))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Separator with the same non-zero count on the most lines of the whole file; `,` if none."""
    return scan(spark, path).delimiter()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is no valid UTF-8, then ISO-8859-1."""
    return scan(spark, path).encoding()


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Header row, every column as text, null tokens as NULL; files are read in splits.

    Files of a folder are matched by the names in their headers, in any order; other names are a
    SourceError, and so are rows with more fields than the header. Missing fields at a row's end are NULL.
    """
    if path.lower().endswith(EXCEL_SUFFIXES):
        raise SourceError("spreadsheets are not read; land them as CSV or Parquet first")
    try:
        found = scan(spark, path, [delimiter] if delimiter else SEPARATORS)
        encoding = encoding or found.encoding()
        delimiter = delimiter or found.delimiter()
        place = 0 if len(found.facts.select("place").distinct().limit(2).collect()) == 1 else SEPARATORS.index(delimiter)
        facts = found.facts.where(f"place = {place}")
        crossing = not facts.where("opens").isEmpty()
        raw = _crossing_records(spark, path, delimiter, encoding) if crossing else _plain_lines(spark, path, delimiter, encoding, facts)
    except SourceError:
        raise
    except Exception as error:
        raise SourceError(f"Failed to load dataset: {error}") from error
    return na_tokens_to_null(raw)


def _options(delimiter: str, encoding: str) -> dict[str, object]:
    return {"header": True, "sep": delimiter, "encoding": encoding, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False}


def _names(header: str, delimiter: str) -> list[str]:
    return next(csv.reader([header], delimiter=delimiter), [])


def _grouped(headers: list[Row], delimiter: str) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their headers, in the order they have there; other names are an error."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(headers, key=lambda r: r["file"]):
        groups.setdefault(tuple(_names(r["header"], delimiter)), []).append(r["file"])
    first = next(iter(groups), ())
    for names, files in groups.items():
        if sorted(names) != sorted(first) or len(groups) > 1 and len(set(names)) < len(names):
            raise SourceError(f"{files[0]} has the header {list(names)}, others have {list(first)}")
    return groups


def _plain_lines(spark: SparkSession, path: str, delimiter: str, encoding: str, facts: DataFrame) -> DataFrame:
    """No record crosses a line, so the reader may cut files anywhere."""
    reader = spark.read.options(**_options(delimiter, encoding))
    widest = [r for r in facts.groupBy("file").agg(F.max("fields").alias("fields")).collect()]
    groups = {(): []}
    if len(widest) > 1:
        groups = _grouped(_first_lines(spark, path, encoding).collect(), delimiter)
    tables = [reader.csv([unquote(f) for f in files] if len(groups) > 1 else path) for files in groups.values()]
    out, width = tables[0], len(tables[0].columns)
    for r in widest:
        if r["fields"] > width:
            raise SourceError(f"a row of {r['file']} has {r['fields']} fields, more than the header's {width}")
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def _first_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file and header of every file."""
    lines = lines_of(spark, path).withColumn("row", F.monotonically_increasing_id()).where("block = 0 and trim(value) <> ''")
    first = lines.groupBy("file").agg(F.expr("min_by(value, row) as value"))
    return first.selectExpr("file", f"{decoded("regexp_replace(value, '\\r$', '')", encoding)} as header")


def _crossing_records(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """Some record holds line breaks: records are put together before they are parsed."""
    lines = lines_of(spark, path).selectExpr(f"{decoded('value', encoding)} as value", "file", "block")
    records = records_of(lines, delimiter)
    headers = records.where("first").select("file", F.regexp_replace("record", "^\ufeff", "").alias("header")).collect()
    groups, rows = _grouped(headers, delimiter), records.where("not first")
    options = {k: str(v) for k, v in _options(delimiter, encoding).items() if k not in ("header", "encoding")}
    out = None
    for names, files in groups.items():
        own = rows if len(groups) == 1 else rows.join(F.broadcast(spark.createDataFrame([(f,) for f in files], "file string")), "file", "left_semi")
        surplus = own.where(f"{fields_of('record', delimiter)} > {len(names)}").select("file", "record").first()
        if surplus is not None:
            raise SourceError(f"a row of {surplus['file']} has more fields than the header's {len(names)}: {surplus['record'][:200]}")
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        shown = [n or f"_c{i}" for i, n in enumerate(names)]
        table = own.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*").toDF(*shown)
        out = table if out is None else out.unionByName(table)
    return out


def na_tokens_to_null(df: DataFrame) -> DataFrame:
    """File null tokens, floating NaN and infinity become NULL; other columns pass through."""
    texts = {c: f"case when {q(c)} not in {any_of(NA_TOKENS)} then {q(c)} end" for c in text_columns(df)}
    return replace_columns(finite(df), texts)


def infer_types(df: DataFrame) -> DataFrame:
    """Text whose values are ALL numbers or ALL true/false takes that type; one pass decides."""
    texts = text_columns(df)
    if not texts:
        return df
    seen = df.selectExpr(*[f"trim({q(c)}) as x{i}" for i, c in enumerate(texts)]).selectExpr("count(1) as total", *[
        e for i in range(len(texts)) for e in (
            f"count(x{i}) as n{i}", f"count_if(x{i} rlike {text(_INTEGER)}) as i{i}",
            f"count_if({looks_numeric(f'x{i}')}) as d{i}", f"count_if(lower(x{i}) in ('true', 'false')) as b{i}")
    ]).first()
    kinds: dict[str, str] = {}
    for i, name in enumerate(texts):
        known, complete = seen[f"n{i}"], seen[f"n{i}"] == seen["total"]
        if known and seen[f"d{i}"] == known:
            kinds[name] = "bigint" if complete and seen[f"i{i}"] == known else "double"
        elif known and complete and seen[f"b{i}"] == known:
            kinds[name] = "boolean"
    typed = {c: f"cast(trim({q(c)}) as {k})" for c, k in kinds.items()}
    return replace_columns(df, {c: finite_value(x) if kinds[c] == "double" else x for c, x in typed.items()})


def load_table(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None
) -> DataFrame:
    return infer_types(read_delimited(spark, path, delimiter, encoding))


def load_status(df: DataFrame) -> DataFrame:
    """One row: did the load bring rows, and what to say when it did not."""
    empty = df.isEmpty()
    width = len(df.columns)
    if not empty:
        message = None
    elif width:
        message = "Dataset contains columns but no data rows (empty dataset)."
    else:
        message = "Uploaded dataset is completely empty."
    return df.sparkSession.createDataFrame(
        [(not empty, width, message)], "success boolean, columns int, error_message string"
    )


def load_metadata(df: DataFrame, path: str) -> DataFrame:
    """File size, shape, names, missing cells and duplicate rows as one row."""
    # Only the listing is read: without `content` no file is opened.
    listing = df.sparkSession.read.format("binaryFile").load(path)
    size = listing.selectExpr(f"{round_scalar('coalesce(sum(length), 0) / 1024', 2)} as kb").scalar()
    missing = " + ".join(f"count_if({q(c)} is null)" for c in df.columns) or "0"
    names = ", ".join(text(c) for c in df.columns)
    facts = df.selectExpr(
        "count(1) as rows", f"{len(df.columns)} as columns", f"array({names}) as column_names",
        f"cast({missing} as bigint) as initial_missing_count",
        f"cast({duplicate_count(df)} as bigint) as initial_duplicate_count",
    )
    return facts.select(size.alias("file_size_kb"), "*")
