"""Links between items that share a bucket, and the components they form, without pairs inside groups.

An item is linked with others by an exact test, supplied by the caller, on pairs. All pairs of a
bucket would be too many where a bucket is large, so items are compared with one hub of each
bucket first. The buckets of one hub are a group then; groups whose items have become one
component are done, the others are compared across components, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import column
from tablewright.sources.staging import discard, drop_finished_shuffles, stage

#: Items of a block; two blocks meet in one task.
BLOCK = 256
#: Rows of blocks that one round moves at least; more rounds are made beyond that and the number of items.
ROUND_ROWS = 100_000
#: Keys that a task packs before it hands them on, and that one task looks through.
PACKED_KEYS, PART_KEYS = 1_000_000, 1_500_000
#: Ranges of keys at most: they are numbered in 16 bits.
MOST_PARTS = 1 << 16
#: Keys whose first halves are carried to every task that looks for them (4 bytes each); of more, all rows go to the join.
CARRIED_KEYS = 8_000_000
PACKED = "part int, keys binary, others binary"


def ranges(spark: SparkSession, keys: int) -> int:
    """Into how many ranges so many 64-bit keys are packed."""
    return min(max(spark.sparkContext.defaultParallelism, keys // PART_KEYS + 1), MOST_PARTS)


def packed(keys: np.ndarray, others: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys with what belongs to each, as one row for each of the ranges that has any.

    Most keys are had once only; as rows of their own they would cost far more than the search for those that are not.
    """
    part = (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16)
    order = np.argsort(part, kind="stable")  # numbers this short are sorted by digits
    keys, others, found = keys[order], others[order], np.searchsorted(part[order], np.arange(parts + 1))
    some = [k for k in range(parts) if found[k] < found[k + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), *(pa.array([x[found[k]:found[k + 1]].tobytes() for k in some], pa.binary()) for x in (keys, others))], names=["part", "keys", "others"])


def unpacked(batches: Iterable[pa.RecordBatch], key: type, other: type) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a range, and what belongs to them."""
    keys, others = [], []
    for batch in batches:
        keys.extend(column(batch, "keys").to_pylist())
        others.extend(column(batch, "others").to_pylist())
    return np.frombuffer(b"".join(keys), dtype=key), np.frombuffer(b"".join(others), dtype=other)


def carried(keys: DataFrame, name: str, count: int) -> Broadcast | None:
    """The first halves of `count` 64-bit keys in a column, for `places_of`; none where they are too many to carry."""
    if count > CARRIED_KEYS:
        return None
    heads = keys.select(F.shiftright(name, 32).cast("int").alias("head")).toArrow()["head"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(np.unique(heads.view(np.uint32)))


def places_of(keys: np.ndarray, heads: Broadcast | None) -> np.ndarray:
    """Places of the keys that may be among those carried: of all that are, and of few others."""
    if heads is None:
        return np.arange(len(keys))
    known, own = heads.value, (keys.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own) if len(known) else np.zeros(0, dtype=np.int64)


def shared_buckets(keys: list[DataFrame], label: str) -> DataFrame:
    """Rows (bucket, id, met, hub) of `keys` (id, bucket) whose bucket has two ids at least; staged.

    Tables of `keys` have no bucket in common; they are shuffled one after the other, so that the disk holds one at a time.
    Counting combines before the shuffle, and its result is staged, so that a frequent bucket's rows may be split in the join.
    """
    whole = []
    for part in keys:
        several = stage(part.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                        .where("first < last").select("bucket"), f"{label}-buckets")
        whole.append(stage(part.join(several, "bucket"), f"{label}-rows"))
        discard(several)
        drop_finished_shuffles(part.sparkSession)
    return with_hubs(whole, label)


def with_hubs(whole: list[DataFrame], label: str) -> DataFrame:
    """Rows (bucket, id, met, hub) of the staged tables `whole` (bucket, id), which are deleted; staged.

    `met` says how many rows share buckets with the id; a bucket's hub is the one that meets most, as
    what copies were made from does, so that few items stay unlinked to it.
    """
    spark = whole[0].sparkSession
    once = stage(reduce(DataFrame.unionByName, whole).distinct(), f"{label}-once")
    discard(*whole)
    sizes = stage(once.groupBy("bucket").agg(F.count("*").alias("n")), f"{label}-sizes")
    met = stage(once.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("met")), f"{label}-met")
    rows = once.join(met, "id").select("bucket", "id", "met")
    hubs = stage(rows.groupBy("bucket").agg(F.max(F.struct("met", "id")).alias("hub")).select("bucket", F.col("hub.id").alias("hub")), f"{label}-hub-of")
    drop_finished_shuffles(spark)
    shared = stage(rows.join(hubs, "bucket"), f"{label}-shared")
    discard(once, sizes, met, hubs)
    drop_finished_shuffles(spark)
    return shared


def components(links: DataFrame, label: str) -> DataFrame:
    """node, component (its smallest reachable node) of every node of `links` (a, b), by star contraction.

    Each round hangs every node's larger neighbours under its smallest one, then its smaller
    neighbours likewise, until nothing changes. Rounds are written to the shared folder; the
    driver sees one checksum a round.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges")
    last = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sums["n"] == 0 or (sums["n"], sums["x"]) == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        last = sums["n"], sums["x"]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = stage(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), f"{label}-lows")
        large = stage(both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), f"{label}-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("low")), f"{label}-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        edges = stage(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), f"{label}-edges")


def united(parts: Iterable[int]) -> tuple[Callable[[int], int], Callable[[int, int], None]]:
    """Union-find over the parts of a pair of blocks: the way to the top, and the join of two."""
    above = {p: p for p in parts}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def join(x: int, y: int) -> None:
        above[top(x)] = top(y)

    return top, join


def blocks(groups: DataFrame, label: str) -> DataFrame:
    """Rows (hub, i, j, side, id, part) that deal each group of `groups` (hub, id, part) to pairs of blocks of bounded size.

    Every two ids of a group with different parts meet in a pair of blocks; the blocks of a
    group's largest part do not meet each other.
    """
    sizes = groups.groupBy("hub", "part").agg(F.count("*").alias("n"))
    sizes = stage(sizes.groupBy("hub").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
                  .where("low < high").select("hub", F.col("top.part").alias("major"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("minors"),
                                              F.ceil(F.col("top.n") / BLOCK).alias("majors")), f"{label}-sizes")
    dealt = groups.join(sizes, "hub").withColumn("all", F.col("minors") + F.col("majors")).withColumn(
        "block", F.when(F.col("part") == F.col("major"), F.col("minors") + F.pmod(F.xxhash64("id"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minors"))))
    small, before = F.col("block") < F.col("minors"), F.least("block", "minors")
    left = dealt.where(small).select("hub", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("all") - 1)).alias("j"), F.lit(0).alias("side"), "id", "part")
    right = dealt.where(before > 0).select("hub", F.explode(F.sequence(F.lit(0).cast("long"), before - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "part")
    return left.unionByName(right)


def per_pair(dealt: DataFrame, facts: list[DataFrame], meet: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str, rows: int, label: str) -> DataFrame:
    """`meet` on the columns of every pair of blocks (hub, i, j) in `dealt` with its ids' `facts`.

    Pairs are handed over in lots of about `rows` rows: most have a few rows, so that a call for each would
    cost more than its work. A large group's ids are in many pairs; lots are met in rounds whose rows
    are no more than there are ids, so that their facts take no more disk than the input does, however
    groups grow. Its rows are staged.
    """
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def lot(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((frame["j"].to_numpy(), frame["i"].to_numpy(), frame["hub"].to_numpy()))
        columns = {c: frame[c].to_numpy()[order] for c in frame.columns if c != "lot"}
        new = np.zeros(len(order), dtype=bool)
        for c in ("hub", "i", "j"):
            new[1:] |= columns[c][1:] != columns[c][:-1]
        found, bounds = [], [0, *np.flatnonzero(new).tolist(), len(order)]
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo > 1:
                found.extend(meet({c: v[lo:hi] for c, v in columns.items()}))
        return pd.DataFrame(found, columns=names, dtype="int64")

    dealt = stage(dealt, f"{label}-dealt")
    spark, counts = dealt.sparkSession, dealt.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first()
    lots = counts["rows"] // rows + 1
    rounds = counts["rows"] // max(ROUND_ROWS, counts["ids"]) + 1
    numbered, met = dealt.withColumn("lot", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(lots))), []
    for k in range(rounds):
        own = numbered.where(F.pmod("lot", F.lit(rounds)) == k)
        for fact in facts:
            own = own.join(fact, "id")
        met.append(stage(own.groupBy("lot").applyInPandas(lot, schema), f"{label}-met"))
        if rounds > 1:
            drop_finished_shuffles(spark)
    discard(dealt)
    return reduce(DataFrame.unionByName, met)


def link(shared: DataFrame, test: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Components (node, component) of the items in `shared` (bucket, id, met, hub).

    `test` takes pairs (a, b), a < b, and returns those that are linked. `rest` takes groups (hub, id, part)
    and returns links between different parts that connect what is linked inside a group; hubs take no part
    there, as each has been tested with its whole group. Two items that
    share a bucket share its hub's group, so every linked pair with a bucket in common ends in one
    component; pairs are left out only where their items are connected already.
    """
    pairs = shared.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    links = stage(test(pairs), f"{label}-links")
    drop_finished_shuffles(links.sparkSession)
    parts = stage(components(links, label), f"{label}-parts")
    member = shared.select("hub", "id").distinct().join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "hub", "id", F.coalesce("component", "id").alias("part"))
    member = stage(member.where("id <> hub"), f"{label}-member")
    mixed = stage(member.groupBy("hub").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("hub"), f"{label}-mixed")
    # What has run meanwhile is known to be finished by now.
    drop_finished_shuffles(links.sparkSession)
    more = stage(rest(member.join(mixed, "hub")), f"{label}-more")
    discard(member, mixed)
    drop_finished_shuffles(more.sparkSession)
    if more.isEmpty():
        return parts
    return stage(components(parts.toDF("a", "b").unionByName(more), label), f"{label}-parts")
