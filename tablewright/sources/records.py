"""Records of quoted text files that may hold line breaks, read in splits.

A split of a text file may begin inside quotes. Reading a line turns "outside quotes" or "inside
quotes" into one of the two, so a split is a function on these states; composing the functions of
the splits before it tells every split how it begins. Then each split cuts its lines into records
on its own, and a record that crosses a border is put together from one piece of each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.sql import text
from tablewright.sources.staging import stage

_WHOLE, _HEAD, _MIDDLE, _TAIL = 0, 1, 2, 3
# The rest of a field that began with a quote, up to its closing quote; possessive, so it never goes back.
_CLOSING = r'[^"]*+(?:""[^"]*+)*+'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value (raw line without its newline), file, block (where its split begins) of every line, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def decoded(value: str, encoding: str) -> str:
    """Text of a raw line."""
    return value if encoding.upper().replace("-", "") == "UTF8" else f"decode(cast({value} as binary), {text(encoding)})"


def ends_inside(separator: str) -> str:
    """Regular expression of a line that begins outside quotes and ends inside; a quote counts where a field begins."""
    s = re.escape(separator)
    field = rf'(?:"{_CLOSING}"[^{s}]*+|[^"{s}][^{s}]*+|)'
    return rf'^(?:{field}{s})*+"{_CLOSING}$'


def fields_of(x: str, separator: str) -> str:
    """Number of fields of a record up to its last one that is not empty."""
    s = re.escape(separator)
    bare = f"""if(contains({x}, '"'), regexp_replace({x}, {text(rf'(^|{s})"{_CLOSING}"')}, '$1x'), {x})"""
    kept = f"""regexp_replace({bare}, {text(rf"(?:{s}[ \r\n]*)+$")}, '')"""
    return f"length({kept}) - length(replace({kept}, {text(separator)}, '')) + 1"


def _line_reader(separator: str):
    """A function (line, inside) -> inside after it."""
    opens, closes = re.compile(ends_inside(separator), re.S), re.compile(_CLOSING + '"')

    def after(line: str, inside: bool) -> bool:
        if inside:
            found = closes.match(line)
            if found is None:
                return True
            rest = line.find(separator, found.end())
            if rest < 0:
                return False
            line = line[rest + len(separator):]
        return opens.match(line) is not None

    return after


def _states(separator: str):
    """Per split: inside quotes at its end, if it begins outside and if it begins inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, at, ends = _line_reader(separator), None, [False, True]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, *ends)], names=["file", "block", "if_outside", "if_inside"])

        for batch in batches:
            lines, files, blocks = (c.to_pylist() for c in batch.columns)
            for line, *place in zip(lines, files, blocks):
                if place != at:
                    if at is not None:
                        yield out()
                    at, ends = place, [False, True]
                if '"' in line:
                    ends = [after(line, e) for e in ends]
        if at is not None:
            yield out()

    return run


def _begins(splits: pd.DataFrame) -> pd.DataFrame:
    """How each split of a file begins, from what the splits before it do."""
    inside, begins = False, []
    splits = splits.sort_values("block")
    for if_outside, if_inside in zip(splits["if_outside"], splits["if_inside"]):
        begins.append(inside)
        inside = bool(if_inside if inside else if_outside)
    return splits[["file", "block"]].assign(inside=begins)


def _pieces(separator: str, begin_inside):
    """Records that lie in one split, and pieces of those that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, known = _line_reader(separator), begin_inside.value
        at, inside, crossing, first, held = None, False, False, False, []
        out: list[tuple] = []

        def emit(kind: int) -> None:
            out.append((*at, first, kind, "\n".join(held)))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "first", "kind", "record"])

        for batch in batches:
            lines, files, blocks = (c.to_pylist() for c in batch.columns)
            for line, *place in zip(lines, files, blocks):
                if place != at:
                    if held:
                        emit(_MIDDLE if crossing else _TAIL)
                    at, first = place, place[1] == 0
                    inside = crossing = tuple(place) in known
                if '"' in line:
                    inside = after(line, inside)
                held.append(line)
                if not inside:
                    emit(_HEAD if crossing else _WHOLE)
                    crossing = first = False
            if out:
                yield batch_of()
        if held:
            emit(_MIDDLE if crossing else _TAIL)
        if out:
            yield batch_of()

    return run


def records_of(lines: DataFrame, separator: str) -> DataFrame:
    """file, first (the first record of its file), record of every record of `lines` (value, file, block); staged.

    Each split is read by a task of its own. What reaches the driver are the splits that begin inside quotes.
    """
    spark = lines.sparkSession
    splits = lines.mapInArrow(_states(separator), "file string, block long, if_outside boolean, if_inside boolean")
    begins = splits.groupBy("file").applyInPandas(_begins, "file string, block long, inside boolean").where("inside")
    known = spark.sparkContext.broadcast({(r["file"], r["block"]) for r in begins.collect()})
    pieces = stage(lines.mapInArrow(_pieces(separator, known), "file string, block long, first boolean, kind int, record string"), "csv-pieces")
    # A few pieces a split; a record begins with a tail and takes what follows up to the next one.
    parts = pieces.where(f"kind <> {_WHOLE}").selectExpr(
        "*", f"sum(if(kind = {_TAIL}, 1, 0)) over (partition by file order by block, kind rows between unbounded preceding and current row) as number")
    joined = parts.groupBy("file", "number").agg(
        F.expr("max(first) as first"), F.expr("array_join(transform(sort_array(collect_list(struct(block, kind, record))), x -> x.record), '\\n') as record"))
    both = pieces.where(f"kind = {_WHOLE}").select("file", "first", "record").unionByName(joined.select("file", "first", "record"))
    return both.selectExpr("file", "first", "regexp_replace(record, '\\r$', '') as record").where("trim(record) <> ''")
