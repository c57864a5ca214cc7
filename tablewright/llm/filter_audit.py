"""How quality filters overlap: what each one removes in every order they could be applied in.

A document fails a set of filters, its mask. Masks (masks x filters: 0 where a filter fails, else
beyond the last step) and the inverse permutations of all orders (orders x filters: the step of each
filter) are combined by minimum of sums: the least step of a failing filter is the step at which a
mask is removed in an order. Counts of documents by mask are scattered to these steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import column, read

#: Filters by letter: the condition under which a document fails, over text, words, different (words), capitals, points.
CONDITIONS = {
    "A": "words < 200",
    "B": "100 * different < 50 * words",
    "C": "100 * capitals > 2 * points",
    "D": "text rlike '[#$%&*|]'",
}
#: The letter of the last filter: the text is that of a smaller doc_id.
REPEATED = "E"
#: Blanks between words.
BLANKS, BETWEEN = " \t\n\x0b\f\r", "[\\x20\\x09-\\x0D]+"
#: Parts whose rows are made at once.
PARTS = 64
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in _MEASURES)


def inverse_orders(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (orders x steps: which filter) and the step (from 1) of each filter in them (orders x filters)."""
    orders = np.array(list(permutations(range(filters))), dtype=np.int64).reshape(-1, filters)
    return orders, np.argsort(orders, axis=1) + 1


def removal_steps(filters: int) -> np.ndarray:
    """Step (masks x orders) at which a mask is removed; `filters` + 1 where it stays."""
    fails = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1
    wait = np.where(fails == 1, 0, filters + 1)
    steps = (wait[:, None, :] + inverse_orders(filters)[1][None, :, :]).min(axis=2, initial=filters + 1)
    return np.minimum(steps, filters + 1)


def interactions(weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Measures (orders x steps) of one part from `weights` (masks x [documents, good ones, toxic ones])."""
    orders, position = inverse_orders(filters)
    steps, every = removal_steps(filters), np.arange(len(orders))
    lost = np.zeros((len(orders), filters + 2, weights.shape[1]), dtype=np.int64)
    np.add.at(lost, (every[None, :], steps), weights[:, None, :])
    removed = lost[:, 1:filters + 1, 0]
    fails = np.arange(1 << filters)[:, None] >> orders.ravel() & 1 == 1
    earlier = steps.repeat(filters, axis=1) < np.tile(np.arange(1, filters + 1), len(orders))
    redundant = (fails & earlier).T.astype(np.int64) @ weights[:, 0]
    whole = np.array([lost[every, position[:, f], 0].sum() for f in range(filters)], dtype=np.int64)
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": redundant.reshape(orders.shape),
        "unique_fails": weights[1 << orders, 0], "good_lost": lost[:, 1:filters + 1, 1], "toxic_lost": lost[:, 1:filters + 1, 2],
        "shapley": whole[orders],
    }


def masks(documents: DataFrame, conditions: Mapping[str, str] = CONDITIONS) -> DataFrame:
    """doc_id, part, digest, mask (bit i: the i-th condition holds) of every document; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("bare", F.btrim("text", F.lit(BLANKS)))
    rows = rows.withColumn("list", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", BETWEEN)))
    rows = rows.select("doc_id", "part", "text", F.size("list").alias("words"), F.size(F.array_distinct("list")).alias("different"),
                       F.length("text").alias("points"), (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("capitals"))
    bits = " + ".join(f"if({test}, {1 << i}, 0)" for i, test in enumerate(conditions.values()))
    # A text's digest stands for it: 32 bytes are shuffled instead of texts.
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.expr(bits).alias("mask"))


def weighted_masks(documents: DataFrame, labels: DataFrame, conditions: Mapping[str, str] = CONDITIONS) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail, repeated texts as the last bit.

    Copies of a text are combined before each shuffle, per part and labels, so neither a text nor a
    part that holds a third of all rows meets in one task.
    """
    rows, repeated = masks(documents, conditions), 1 << len(conditions)
    marks = (labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
             .agg(F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic")))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    facts = ["digest", "part", "mask", "good", "toxic"]
    # The rows of the least id of each text, part and labels, beside all of them.
    per_id = known.groupBy("doc_id", *facts).agg(F.count("*").alias("n"))
    groups = per_id.groupBy(*facts).agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    groups = groups.selectExpr("*", "min(first.doc_id) over (partition by digest) as least")
    split = groups.selectExpr("part", "mask", "good", "toxic", "if(first.doc_id = least, first.n, 0L) as first_n", "n").selectExpr(
        "part", "good", "toxic", f"inline(array(struct(mask, first_n as n), struct(mask + {repeated} as mask, n - first_n as n)))")
    # Rows without an id have no smaller one and no labels.
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).selectExpr("part", "0 as good", "0 as toxic", "mask", "n")
    return split.where("n > 0").unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic"))


def filter_audit(documents: DataFrame, labels: DataFrame, conditions: Mapping[str, str] = CONDITIONS, repeated: str = REPEATED) -> DataFrame:
    """One row per part (source; NULL is the empty string), order of the filters and step, with counts within the part.

    The filters are `conditions` (letter -> SQL condition over text, words, different, capitals, points)
    and, as the last one, `repeated`: the text is identical to that of a smaller doc_id anywhere in the table.
    kept, removed, redundant (fail the step's filter, removed earlier), unique_fails (fail nothing else),
    good_lost and toxic_lost (removed here, labelled so), shapley (removed by the step's filter over all orders).
    NULL texts are empty ones; a row without a doc_id repeats nothing, is repeated by nothing and has no
    labels. Repeated rows count one by one; rows with the same id and text do not repeat each other. Of several
    labels of an id, one that says 1 is enough. Very long texts are looked at whole; other columns are ignored;
    an empty table gives no rows.
    """
    letters = [*conditions, repeated]
    entries = weighted_masks(documents, labels, conditions).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))  # at most one for each mask

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, _ = inverse_orders(len(letters))
        names = np.repeat(np.array(["".join(letters[f] for f in order) for order in orders]), len(letters))
        step = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                block = batch.slice(at, PARTS)
                parts, found = column(block, "part").to_pylist(), []
                for rows in column(block, "entries").to_pylist():
                    weights = np.zeros((1 << len(letters), 3), dtype=np.int64)
                    for r in rows:
                        weights[r["mask"]] += r["n"], r["good"], r["toxic"]
                    found.append(interactions(weights, len(letters)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(parts, dtype=object), len(step)), pa.string()), pa.array(np.tile(names, len(parts)), pa.string()),
                     pa.array(np.tile(step, len(parts))), *(pa.array(np.concatenate([f[m].ravel() for f in found])) for m in _MEASURES)],
                    names=["part", "filter_order", "step", *_MEASURES])

    return entries.mapInArrow(audit, _SCHEMA)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


OP12_SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) as c,
  regexp_matches(text, '[#$%&*|]') as d,
  coalesce(doc_id > min(doc_id) over (partition by text), false) as e from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
g as (select part, a, b, c, d, e, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
r as (select g.*, filter_order, least(if(a, strpos(filter_order, 'A'), 6), if(b, strpos(filter_order, 'B'), 6), if(c, strpos(filter_order, 'C'), 6),
  if(d, strpos(filter_order, 'D'), 6), if(e, strpos(filter_order, 'E'), 6)) as gone from g, o),
s as (select unnest([1, 2, 3, 4, 5]) as step),
m as (select part, filter_order, step, substr(filter_order, step, 1) as letter,
  case letter when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
  a::int + b::int + c::int + d::int + e::int as failed, gone, n, good, toxic from r, s),
y as (select part, filter_order, step, letter, sum(n) filter (where gone > step) as kept, sum(n) filter (where gone = step) as removed,
  sum(n) filter (where fails and gone < step) as redundant, sum(n) filter (where fails and failed = 1) as unique_fails,
  sum(good) filter (where gone = step) as good_lost, sum(toxic) filter (where gone = step) as toxic_lost from m group by all)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, letter), 0) as bigint) as shapley from y
"""
