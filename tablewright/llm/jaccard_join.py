"""N-gram Jaccard join: prefix filter over a global order, then set tries searched with length bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import chunks, column, read, texts_of
from tablewright.llm.linkage import (
    PACKED, PACKED_KEYS, blocks, carried, link, packed, per_pair, places_of, ranges, shared_buckets, united, unpacked,
)
from tablewright.operators.dedup import remove_duplicates
from tablewright.sources.staging import discard, drop_finished_shuffles, stage

_DROPPED = "__jaccard_dropped"

WIDTH = 4
#: Similarity as a fraction of whole numbers, so that the comparison is exact.
PERCENT = 85
#: A shingle in the prefix pools of more texts than this goes to the end of the global order.
FREQUENT = 24
#: Sets of one trie at most; a probe with more candidates meets several tries.
TRIE_SETS = 256
#: Rows of small pairs of blocks that one call takes.
LOT_ROWS = 256
#: Characters whose words are hashed at once; their arrays stay in a core's cache.
SHINGLE_CHARS = 40_000
#: Ids that are broadcast at most when texts are read again; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Places in a word with byte codes of their own; beyond, they come again under other factors.
PLACES = 64


class Shingler:
    """Sorted distinct 63-bit hashes of texts' word shingles; words are ASCII-lower-cased runs of non-blank bytes.

    Many texts are hashed at once, as arrays: a word's hash is the sum of random codes of its bytes at their places.
    """

    def __init__(self, width: int):
        self.width = width
        self.codes = np.random.default_rng(29).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
        self.codes[:, 65:91] = self.codes[:, 97:123]
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, text: str) -> np.ndarray:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """The hashes of every text."""
        found: list[np.ndarray] = []
        for lo, hi in chunks(texts, SHINGLE_CHARS):
            found.extend(self._some([x.encode("utf-8", "surrogatepass") for x in texts[lo:hi]]))
        return found

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        at = np.flatnonzero(~self.blank[data])
        if not len(at):
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        begins = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        lengths = np.diff(np.append(begins, len(at)))
        place = np.arange(len(at)) - np.repeat(begins, lengths)
        coded = self.codes[place % PLACES, data[at]]
        if len(lengths) and lengths.max() > PLACES:
            coded *= (2 * (place // PLACES) + 1).astype(np.uint64)
        word = np.add.reduceat(coded, begins)
        word ^= word >> np.uint64(32)
        ends = np.cumsum([len(x) + 1 for x in texts])
        bounds = np.concatenate(([0], np.searchsorted(at[begins], ends)))
        return [self._shingles(word[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _shingles(self, word: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros(0, dtype=np.int64)
        runs = max(1, len(word) - self.width + 1)
        value = np.full(runs, min(len(word), self.width), dtype=np.uint64)
        for i in range(min(len(word), self.width)):
            value ^= word[i:i + runs]
            value *= np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value >>= np.uint64(1)
        value.sort()
        return value[np.concatenate(([True], value[1:] != value[:-1]))].view(np.int64)


def prefix_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """A set's first so many shingles of the global order meet those of every set it is linked with."""
    return size - -(-percent * size // 100) + 1


def sketch(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (s1, s2) and its smallest hashes (pool), of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width)
        for batch in batches:
            sizes, s1, s2, pools = [], [], [], []
            for found in own.all(texts_of(batch)):
                digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype=np.int64)
                sizes.append(len(found))
                s1.append(int(digest[0]))
                s2.append(int(digest[1]))
                pools.append(found[:prefix_length(len(found), percent) * 9 // 8 + 4])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(pools, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "s1", "s2", "pool"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, s1 long, s2 long, pool array<long>")


def sets(documents: DataFrame, width: int) -> DataFrame:
    """id and all shingle hashes in ascending order."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [column(rows, "id"), pa.array(own.all(texts_of(rows)), pa.list_(pa.int64()))],
                    names=["id", "shingles"])

    return documents.select("id", "text").mapInArrow(whole, "id long, shingles array<long>")


def pool_counts(pools: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, frequent) of the hashes that the pools (`pool`) of several sets have.

    A task adds up what is equal before it hands hashes on, so that one that all sets have is a row for each task.
    """

    def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[new], np.add.reduceat(counts, new) if len(new) else counts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(column(batch, "pool").flatten().to_numpy(zero_copy_only=False))
            count += len(held[-1])
            if count >= PACKED_KEYS:
                yield packed(*summed(np.concatenate(held), np.ones(count, dtype=np.int64)), parts)
                held, count = [], 0
        if count:
            yield packed(*summed(np.concatenate(held), np.ones(count, dtype=np.int64)), parts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(*unpacked(batches, np.int64, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 1]), pa.array(counts[counts > 1] > FREQUENT)], names=["bucket", "frequent"])

    return pools.select("pool").mapInArrow(pack, PACKED).repartitionById(parts, "part").mapInArrow(total, "bucket long, frequent boolean")


def shared_hashes(pools: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (id, n, at, bucket, frequent) of the pools' hashes that `counts` (bucket, frequent) names; `at` is the place in the pool.

    The first halves of those hashes go with the tasks, so that few rows besides them leave the pools.
    """
    heads = carried(counts, "bucket", counts.count())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, lists = column(batch, "id").to_numpy(), column(batch, "n").to_numpy(), column(batch, "pool")
            keys, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(ids)), lengths)
            at = np.arange(len(keys)) - np.repeat(np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths)
            k = places_of(keys, heads)
            for part in range(0, len(k), PACKED_KEYS):
                few = k[part:part + PACKED_KEYS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own[few]]), pa.array(sizes[own[few]]), pa.array(at[few].astype(np.int32)), pa.array(keys[few])], names=["id", "n", "at", "bucket"])

    return pools.select("id", "n", "pool").mapInArrow(chosen, "id long, n long, at int, bucket long").join(counts, "bucket")


def frequent_last(shared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefix rows (id, bucket) under the order that puts frequent shingles last, ids whose pool is too short for it, and the staged table of both.

    `shared` (id, n, at, bucket, frequent) has a row for each pool shingle that several sets have;
    `at` is its place among the set's hashes, so that the others need no row to be counted.
    """
    before = F.sum(F.col("frequent").cast("int")).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ranked = stage(shared.withColumn("place", F.col("at") - F.coalesce(before, F.lit(0))), "jaccard-ranked")
    drop_finished_shuffles(shared.sparkSession)
    hits = ranked.where("frequent").groupBy("id", "n").agg(F.count("*").alias("hits"))
    prefix = F.expr(f"n - cast(ceil({percent} * n / 100) as long) + 1")
    pool = F.least(F.col("n"), F.floor(prefix * 9 / 8) + 4)
    short = hits.where(pool - F.col("hits") < prefix).select("id")
    return ranked.where(~F.col("frequent") & (F.col("place") < prefix)).select("id", "bucket"), short, ranked


class Trie:
    """Sets as paths of ascending shingles; a node holds a run of shingles and the sizes of the sets below.

    Nodes are numbered parents first and their runs lie in one array, so that a probe is compared
    with all runs at once and the search itself only adds up counts.
    """

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.parent, self.stop, self.low, self.high, self.ends = [], [], [], [], []
        runs: list[np.ndarray] = []
        todo = [(members, 0, -1)]
        while todo:
            group, depth, parent = todo.pop()
            first, sizes = group[0][1], [len(s) for _, s in group]
            stop = min(sizes)
            for _, other in group[1:]:
                differ = np.flatnonzero(first[depth:stop] != other[depth:stop])
                if len(differ):
                    stop = depth + int(differ[0])
            own, below = [], {}
            for member in group:
                if len(member[1]) == stop:
                    own.append(member[0])
                else:
                    below.setdefault(int(member[1][stop]), []).append(member)
            node = len(runs)
            runs.append(first[depth:stop])
            for values, value in zip((self.parent, self.stop, self.low, self.high, self.ends), (parent, stop, min(sizes), max(sizes), own)):
                values.append(value)
            todo.extend((g, stop, node) for g in below.values())
        lengths = np.array([len(r) for r in runs])
        self.flat = np.concatenate(runs)
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.last = np.array([r[-1] if len(r) else -1 for r in runs], dtype=np.int64)

    def search(self, probe: np.ndarray, percent: int) -> list[int]:
        """Ids of the sets with 100 * intersection >= percent * union.

        A branch is left once the shingles matched so far and those that can still match are
        too few for its smallest set.
        """
        at = np.minimum(np.searchsorted(probe, self.flat), len(probe) - 1)
        sums = np.concatenate(([0], np.cumsum(probe[at] == self.flat)))
        own = (sums[self.bounds[1:]] - sums[self.bounds[:-1]]).tolist()
        left = (len(probe) - np.searchsorted(probe, self.last, side="right")).tolist()
        size, found, matched = len(probe), [], [0] * len(own)
        for node, (parent, stop, low, high) in enumerate(zip(self.parent, self.stop, self.low, self.high)):
            before = matched[parent] if parent >= 0 else 0
            if before < 0:
                matched[node] = -1
                continue
            here = before + own[node]
            if self.ends[node] and 100 * here >= percent * (size + stop - here):
                found.extend(self.ends[node])
            hope = here + min(left[node], high - stop)
            matched[node] = here if (100 + percent) * hope >= percent * (size + low) else -1
        return found


def compact(pools: DataFrame) -> DataFrame:
    """id, n and the first 31 bits of the pool's hashes: a third of the bytes, in the same order."""
    return pools.select("id", "n", F.transform("pool", lambda x: F.shiftright(x, 32).cast("int")).alias("pool"))


def hopeful(pairs: DataFrame, pools: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose pools do not rule a link out, with a's number of them left.

    Up to the smaller of both pools' last shingles the sets are known whole; beyond, they share no more
    than the smaller rest. Most pairs that meet only in a common passage end here, without their sets.
    """
    left, right = pools.toDF("a", "a_n", "a_pool"), pools.toDF("b", "b_n", "b_pool")
    near = (pairs.join(pools.select("id", "n").toDF("a", "n_of_a"), "a").join(pools.select("id", "n").toDF("b", "n_of_b"), "b")
            .where(100 * F.least("n_of_a", "n_of_b") >= percent * F.greatest("n_of_a", "n_of_b")).select("a", "b"))
    both = near.join(left, "a").join(right, "b")
    last = F.least(F.element_at("a_pool", -1), F.element_at("b_pool", -1))
    rest = F.least(F.col("a_n") - F.size(F.filter("a_pool", lambda x: x <= F.col("last"))),
                   F.col("b_n") - F.size(F.filter("b_pool", lambda x: x <= F.col("last"))))
    most = both.withColumn("last", last).withColumn("most", F.size(F.array_intersect("a_pool", "b_pool")) + rest)
    return most.where(100 * F.col("most") >= percent * (F.col("a_n") + F.col("b_n") - F.col("most"))).select("a", "b")


def trie_test(texts: DataFrame, pools: DataFrame, width: int, percent: int):
    """The linked ones among pairs (a, b): each a probes tries of its b's."""

    def search(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(probes) and len(members):
            probe = probes["probe"].iloc[0]
            trie = Trie(list(zip(members["b"], members["shingles"])))
            found = [(int(probes["a"].iloc[0]), int(b)) for b in trie.search(probe, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def test(pairs: DataFrame) -> DataFrame:
        left = stage(hopeful(pairs, pools, percent), "jaccard-hopeful")
        ids = stage(left.select(F.col("a").alias("id")).union(left.select("b")).distinct(), "jaccard-ids")
        sought = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        shingles = stage(sets(texts.join(sought, "id", "left_semi").dropDuplicates(["id"]), width), "jaccard-sets")
        drop_finished_shuffles(texts.sparkSession)
        counts = stage(left.groupBy("a").agg(F.ceil(F.count("*") / TRIE_SETS).alias("tries")), "jaccard-counts")
        near = left.join(shingles.toDF("b", "shingles"), "b")
        members = near.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tries")).alias("trie"), "shingles")
        probes = counts.join(shingles.toDF("a", "probe"), "a").select(
            "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tries") - 1)).alias("trie"), "probe")
        found = stage(probes.groupBy("a", "trie").cogroup(members.groupBy("a", "trie")).applyInPandas(search, "a long, b long")
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "jaccard-found")
        discard(left, ids, shingles, counts)
        return found

    return test


def block_test(texts: DataFrame, pools: DataFrame, width: int, percent: int):
    """Links that connect what is linked inside groups (hub, id, part).

    A first pass over the blocks, with compact pools, finds the ids that any other part's id might be linked with; a
    second one meets their sets in tries and returns links that join parts not joined so far. Hashes that
    are equal in a compact pool, or equal to its last, only raise the overlap that is held possible.
    """

    def hope(group: dict[str, np.ndarray]) -> list[tuple]:
        order = np.argsort(group["n"], kind="stable")
        ids, parts, sizes, arrays = (group[c][order].tolist() for c in ("id", "part", "n", "pool"))
        sides = group["side"][order].tolist() if group["i"][0] != group["j"][0] else range(len(ids))
        ends, pool, open_to = [p[-1] for p in arrays], [set(p.tolist()) for p in arrays], [False] * len(ids)
        twice = [len(p) - len(s) for p, s in zip(arrays, pool)]
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                if 100 * sizes[x] < percent * sizes[y]:
                    break
                if parts[x] == parts[y] or sides[x] == sides[y] or (open_to[x] and open_to[y]):
                    continue
                common = len(pool[x] & pool[y]) + min(twice[x], twice[y])
                last = min(ends[x], ends[y])
                most = common + min(sizes[x] - int(np.searchsorted(arrays[x], last)), sizes[y] - int(np.searchsorted(arrays[y], last)))
                if 100 * most >= percent * (sizes[x] + sizes[y] - most):
                    open_to[x] = open_to[y] = True
        hub = int(group["hub"][0])
        return [(hub, i, p) for i, p, h in zip(ids, parts, open_to) if h]

    def meet(group: dict[str, np.ndarray]) -> list[tuple]:
        side = group["side"]
        asked, held = (range(len(side)),) * 2 if group["i"][0] == group["j"][0] else (np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist())
        if not len(asked) or not len(held):
            return []
        ids, parts, shingles = group["id"].tolist(), group["part"].tolist(), group["shingles"]
        trie, part, found = Trie([(ids[k], shingles[k]) for k in held]), dict(zip(ids, parts)), []
        top, join = united(parts)
        for a in asked:
            for b in trie.search(shingles[a], percent):
                if top(parts[a]) != top(part[b]):
                    join(parts[a], part[b])
                    found.append((min(ids[a], b), max(ids[a], b)))
        return found

    def rest(groups: DataFrame) -> DataFrame:
        small = stage(compact(pools).join(groups.select("id").distinct(), "id", "left_semi"), "jaccard-small")
        hopeful = per_pair(blocks(groups, "jaccard"), [small], hope, "hub long, id long, part long", LOT_ROWS, "jaccard")
        hopeful = stage(hopeful.distinct(), "jaccard-open")
        discard(small)
        ids = stage(hopeful.select("id").distinct(), "jaccard-ids")
        sought = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        shingles = stage(sets(texts.join(sought, "id", "left_semi").dropDuplicates(["id"]), width), "jaccard-sets")
        found = per_pair(blocks(hopeful, "jaccard"), [shingles], meet, "a long, b long", LOT_ROWS, "jaccard")
        discard(ids, shingles)
        return found

    return rest


def jaccard_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest linked doc_id, itself included) of every row of `documents`.

    Documents are linked if 100 * intersection >= percent * union of their sets of `width`-word
    shingles; with fewer words, the whole sequence is the one shingle; without words, or with a NULL
    text, the set is empty and linked with nothing. A NULL doc_id takes no part in links and stays NULL
    with a NULL component. Rows that repeat a doc_id are one document, linked by the largest of
    their sets; equal sets are compared once. No rows give no rows.
    """
    signed = stage(sketch(documents, width, percent), "jaccard-sketch")
    key = F.struct("n_shingles", "s1", "s2")
    usable = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "s1", "s2")
    chosen = stage(usable.groupBy("doc_id").agg(F.max(key).alias("k")).select("doc_id", "k.*"), "jaccard-chosen")
    classes = stage(chosen.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("first_id")), "jaccard-classes")
    member = stage(chosen.join(classes, ["n_shingles", "s1", "s2"]).select("doc_id", "first_id"), "jaccard-member")
    copies = member.where("doc_id <> first_id").select("doc_id")
    rows = signed.where("doc_id is not null and n_shingles > 0")
    if usable.count() > chosen.count():
        rows = rows.withColumn("k", key).groupBy("doc_id").agg(F.max_by("pool", "k").alias("pool"), F.max("k").alias("k")).select("doc_id", "k.*", "pool")
    leads = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    leads = leads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "pool")
    spark = documents.sparkSession
    parts = ranges(spark, signed.agg(F.sum(F.size("pool"))).first()[0] or 0)
    counts = stage(pool_counts(leads, parts), "jaccard-counts")
    drop_finished_shuffles(spark)
    shared = stage(shared_hashes(leads, counts).select("id", "n", "at", "bucket", "frequent"), "jaccard-shared")
    drop_finished_shuffles(documents.sparkSession)
    prefix, short, ranked = frequent_last(shared, percent)
    discard(shared)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    # Where frequent shingles fill the pool, the whole set is put into the global order.
    few = stage(short, "jaccard-short")
    if not few.isEmpty():
        whole = sets(texts.join(few, "id", "left_semi").dropDuplicates(["id"]), width).select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("bucket"))
        ordered = whole.join(counts.where("frequent"), "bucket", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("frequent", "bucket"))
        rest = ordered.withColumn("rank", rank).where(F.expr(f"rank <= n - cast(ceil({percent} * n / 100) as long) + 1")).select("id", "bucket")
        prefix = prefix.join(few, "id", "left_anti").unionByName(rest)
    buckets = shared_buckets([prefix], "jaccard")
    discard(ranked)
    linked = link(buckets, trie_test(texts, leads, width, percent), block_test(texts, leads, width, percent), "jaccard")
    linked = stage(linked, "jaccard-linked")
    discard(buckets)
    place = member.join(linked.withColumnRenamed("node", "first_id"), "first_id", "left").select("doc_id", F.coalesce("component", "first_id").alias("component_id"))
    place = stage(place.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "jaccard-place")
    return signed.select("doc_id", "n_shingles").join(place, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, **how) -> DataFrame:
    """`documents` with only the lowest doc_id of each component, and fully repeated rows once; rows with a NULL id stay.

    Columns of any other name are kept as they are.
    """
    place = jaccard_components(documents, **how)
    drop = stage(place.where("component_id < doc_id").select(F.col("doc_id").alias(_DROPPED)).distinct(), "jaccard-dropped")
    return remove_duplicates(documents.join(drop, F.col("doc_id") == F.col(_DROPPED), "left_anti"))


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read(spark, folder, "documents"))


OP10_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
grams as (
  select distinct doc_id, list_aggregate(list_slice(w, i, i + 3), 'string_agg', ' ') as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by 1),
links as (
  select a.doc_id as a, b.doc_id as b from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id
  group by 1, 2
  having 100 * count(*) >= 85 * ((select n from sizes where doc_id = a.doc_id) + (select n from sizes where doc_id = b.doc_id) - count(*))),
reach as (select doc_id, doc_id as other from words union select reach.doc_id, links.b from reach join links on reach.other = links.a)
select w.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.other) as component_id
from words w join reach r on r.doc_id = w.doc_id left join sizes s on s.doc_id = w.doc_id group by 1
"""
