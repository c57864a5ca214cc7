"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import chunks, column, read, texts_of
from tablewright.llm.linkage import (
    PACKED, PACKED_KEYS, blocks, carried, link, packed, per_pair, places_of, ranges, united, unpacked, with_hubs,
)
from tablewright.sources.staging import discard, drop_finished_shuffles, stage

#: Characters of a shingle; a shorter line is one shingle.
CHARS = 5
PERCENT = 80
#: Signature: MINIMA minima, and BANDS bands that take ROWS of them each; bands overlap. Lines with a similarity of 0.8 share
#: a band with a chance of 0.998, of 0.3 with 0.02, of 0.1 with 0.00003: what shares one grows with the near copies, not with all pairs.
MINIMA, BANDS, ROWS = 64, 32, 6
#: Different lines a task remembers to have signed; beyond, it signs some again.
KNOWN_LINES = 5_000_000
#: Shingles by which sizes and overlaps of hashed sets may be off: what they rule out is ruled out for certain.
SLACK = 3
#: Minima that two lines of a block share at least to be compared: at a similarity of 0.8 fewer come once in 70,000 pairs.
AGREE = 37
#: The same for a line and the hub of a bucket: at a similarity of 0.8 fewer agree once in a billion pairs.
AGREE_HUB = 30
#: Bands whose keys are shuffled at once.
BANDS_AT_ONCE = 8
#: Characters signed at once: their hashes stay in a core's cache.
SIGN_CHARS = 100_000
#: Ids that are broadcast at most when lines are read again; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs whose hashed sets are compared at once.
PAIRS = 2000
_DOC, _TEXT, _LOST = "__lines_doc", "__lines_text", "__lines_lost"
#: Rows of small pairs of blocks that one call takes.
LOT_ROWS = 1024


def _factors() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 31, MINIMA, dtype=np.uint32) * 2 + 1


def band_minima() -> list[np.ndarray]:
    """Which minima each band takes: each deal of all minima makes as many bands as it can, so that all are used alike."""
    draw, taken = np.random.default_rng(5), []
    while len(taken) < BANDS:
        dealt = draw.permutation(MINIMA)
        taken.extend(dealt[i:i + ROWS] for i in range(0, MINIMA - ROWS + 1, ROWS))
    return taken[:BANDS]


def shingle_hashes(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lines' shingles, line by line, and where each line begins.

    Runs of doubled length are hashed from two halves that may overlap; a shorter line is filled up to one shingle.
    """
    padded = [x.ljust(chars, "\0") for x in lines]
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    value = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    have = 1
    while have < chars:
        step = min(have, chars - have)
        mixed = value[:-step] * np.uint64(0x9E3779B97F4A7C15)
        mixed += value[step:]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        value, have = mixed, have + step
    ends = np.cumsum(lengths)
    inside = np.ones(len(value) + chars - 1, dtype=bool)
    for i in range(1, chars):
        inside[ends - i] = False
    counts = lengths - (chars - 1)
    return value[inside[:len(value)]], np.concatenate(([0], np.cumsum(counts)))[:-1]


def hashed_sets(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """40-bit hashes of the different shingles of each line, line by line, and where each line begins (one more at the end).

    Shingles that share a hash count once: sizes and overlaps may be a little off, see `SLACK`.
    """
    return distinct_hashes(*shingle_hashes(lines, chars))


def distinct_hashes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`hashed_sets` of lines whose shingles are hashed already."""
    owner = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(values))))
    keys = (owner << np.uint64(40)) | (values >> np.uint64(24))
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return keys & np.uint64((1 << 40) - 1), np.searchsorted(keys, np.arange(len(first) + 1, dtype=np.uint64) << np.uint64(40))


def may_be_similar(left: list[str], right: list[str], chars: int, percent: int) -> np.ndarray:
    """Which pairs of lines may have similar shingle sets; none that has is left out."""
    return compared(left, right, chars, percent)[0]


def compared(left: list[str], right: list[str], chars: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of lines may have similar shingle sets, and which of them have for certain."""
    place: dict[str, int] = {}
    a = np.array([place.setdefault(x, len(place)) for x in left])
    b = np.array([place.setdefault(x, len(place)) for x in right])
    values, at = hashed_sets(list(place), chars)
    size = np.diff(at)

    def of_pairs(rows: np.ndarray) -> np.ndarray:
        """Hashes of one side of every pair, each with the pair's number before it."""
        n = size[rows]
        begin = np.repeat(at[rows] - np.concatenate(([0], np.cumsum(n)))[:-1], n)
        return (np.repeat(np.arange(len(rows), dtype=np.uint64), n) << np.uint64(40)) | values[begin + np.arange(n.sum())]

    both = np.concatenate((of_pairs(a), of_pairs(b)))
    both.sort()
    shared = both[1:][both[1:] == both[:-1]] >> np.uint64(40)
    common = np.bincount(shared.astype(np.int64), minlength=len(a))
    least, most = size[a] + size[b] - common - SLACK, size[a] + size[b] - common + 3 * SLACK
    return 100 * (common + SLACK) >= percent * least, 100 * (common - SLACK) >= percent * most


def signatures(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty lines' minima one byte for the bands, another one for the sketch (lines x MINIMA each), and sizes."""
    values, first = shingle_hashes(lines, chars)
    sizes = np.diff(distinct_hashes(values, first)[1])
    values = (values >> np.uint64(32)).astype(np.uint32)
    both = np.empty((2, len(lines), MINIMA), dtype=np.uint8)
    mixed = np.empty_like(values)
    for i, factor in enumerate(_factors()):
        np.multiply(values, factor, out=mixed)
        least = np.minimum.reduceat(mixed, first) * np.uint32(0x9E3779B1)
        both[0, :, i] = least >> np.uint32(16)
        both[1, :, i] = least >> np.uint32(24)
    return both[0], both[1], sizes


def band_keys(bands: np.ndarray, sketch: np.ndarray, which: range) -> np.ndarray:
    """64-bit keys (lines x bands) of the bands `which`, from both bytes of the minima."""
    minima = np.ascontiguousarray(((bands.astype(np.uint16) << 8) | sketch).T)
    keys, taken = np.empty((len(which), len(bands)), dtype=np.uint64), band_minima()
    for own, band in zip(keys, which):
        own[:] = band
        for i in taken[band]:
            own ^= minima[i]
            own *= np.uint64(0x9E3779B97F4A7C15)
            own ^= own >> np.uint64(29)
    return keys.T


def fixed(array: pa.Array, width: int) -> np.ndarray:
    """Bytes (rows x width) of an array of binaries of that width, none of them NULL."""
    array = array.cast(pa.binary())
    begin = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset] if len(array) else 0
    return np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[begin:begin + len(array) * width].reshape(len(array), width)


def shared_sets(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (bucket, id) of the keys that several ids have, once for all keys that the same ids have.

    A bucket is named by a sum over its ids. Should two sets have the same sum, their ids are one bucket, and none is lost.
    """
    if not len(keys):
        return keys.view(np.int64), ids
    order = np.argsort(keys)
    ranked = keys[order]
    again = ranked[1:] == ranked[:-1]
    kept = np.concatenate((again, [False])) | np.concatenate(([False], again))
    keys, ids = ranked[kept], ids[order[kept]]
    for sums in (False, True):
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))) if len(keys) else np.zeros(0, dtype=bool)
        keys, ids = keys[new], ids[new]
        if sums or not len(keys):
            return keys.view(np.int64), ids
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        count = np.diff(np.append(begin, len(keys)))
        several = np.repeat(count > 1, count)
        keys, ids = np.repeat(np.add.reduceat(mixed, begin), count)[several], ids[several]
    return keys, ids


def band_buckets(known: DataFrame, which: range, parts: int) -> DataFrame:
    """Rows (bucket, id) of the lines in `known` (id, bands, sketch) that share one of the bands `which` with others.

    Keys are packed by ranges before they are shuffled, and a task looks through one range as arrays.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, count = [], [], 0
        for batch in batches:
            if batch.num_rows:
                own = band_keys(fixed(column(batch, "bands"), MINIMA), fixed(column(batch, "sketch"), MINIMA), which)
                keys.append(own.ravel())
                ids.append(np.repeat(column(batch, "id").to_numpy(), len(which)))
                count += own.size
                if count >= PACKED_KEYS:
                    yield packed(np.concatenate(keys), np.concatenate(ids), parts)
                    keys, ids, count = [], [], 0
        if keys:
            yield packed(np.concatenate(keys), np.concatenate(ids), parts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, ids = shared_sets(*unpacked(batches, np.uint64, np.int64))
        for k in range(0, len(ids), PACKED_KEYS):
            yield pa.RecordBatch.from_arrays([pa.array(buckets[k:k + PACKED_KEYS]), pa.array(ids[k:k + PACKED_KEYS])], names=["bucket", "id"])

    packs = known.select("id", "bands", "sketch").mapInArrow(pack, PACKED)
    return packs.repartitionById(parts, "part").mapInArrow(search, "bucket long, id long")


def line_buckets(known: DataFrame) -> DataFrame:
    """Rows (bucket, id, met, hub) of lines that share bands with others; staged. Bands go in turns, so that the disk holds the keys of a few."""
    spark, whole = known.sparkSession, []
    parts = ranges(spark, known.count() * BANDS_AT_ONCE)
    for k in range(0, BANDS, BANDS_AT_ONCE):
        whole.append(stage(band_buckets(known, range(k, min(BANDS, k + BANDS_AT_ONCE)), parts), "lines-rows"))
        drop_finished_shuffles(spark)
    return with_hubs(whole, "lines")


def line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def sign_lines(documents: DataFrame, chars: int) -> DataFrame:
    """doc_id, text_id (hash of the text), line (from 0), id (64-bit hash of the stripped line), bands, sketch, n of every line that is not blank.

    Bands and sketch (a byte of each of the minima) and n (size of the shingle set, up to `SLACK`) are given where a task
    meets a line first, and NULL where it comes again.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            docs, digests, texts = column(batch, "doc_id").to_pylist(), column(batch, "text_id").to_pylist(), texts_of(batch)
            for lo, hi in chunks(texts, SIGN_CHARS):
                owners, versions, places, lines = [], [], [], []
                for doc, digest, text in zip(docs[lo:hi], digests[lo:hi], texts[lo:hi]):
                    for k, line in enumerate(text.split("\n")):
                        if own := line.strip(" \t\r"):
                            owners.append(doc)
                            versions.append(digest)
                            places.append(k)
                            lines.append(own)
                if not lines:
                    continue
                ids = [line_id(x) for x in lines]
                if len(known) > KNOWN_LINES:
                    known.clear()  # then some lines are given again
                new = [i for i, own in enumerate(ids) if not (own in known or known.add(own))]
                first = [lines[i] for i in new]
                bands, sketch, sizes = signatures(first, chars) if first else (*[np.zeros((0, MINIMA), np.uint8)] * 2, np.zeros(0))
                at = np.full(len(lines), -1)
                at[new] = np.arange(len(new))
                take = pa.array(at, mask=at < 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners, pa.int64()), pa.array(versions, pa.int64()), pa.array(places, pa.int32()), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)),
                     *(pa.array([x.tobytes() for x in own], pa.binary()).take(take) for own in (bands, sketch)), pa.array(sizes.astype(np.int32)).take(take)],
                    names=["doc_id", "text_id", "line", "id", "bands", "sketch", "n"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_id long, line int, id long, bands binary, sketch binary, n int")


def line_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id, content of the lines of `documents` that `ids` (id, no two equal) names, each once; staged.

    Texts are cut into lines again, which costs little beside keeping every line on disk until it is known which are compared.
    The first halves of the ids go with the tasks, so that few lines besides those sought leave them.
    """
    count = ids.count()
    heads = carried(ids, "id", count)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in chunks(texts, 400_000):
                if len(known) > KNOWN_LINES:
                    known.clear()
                lines = [own for text in texts[lo:hi] for line in text.split("\n") if (own := line.strip(" \t\r"))]
                keys = np.fromiter(map(line_id, lines), dtype=np.uint64, count=len(lines))
                new = {}
                for k in places_of(keys, heads).tolist():
                    if (key := int(keys[k])) not in known:
                        known.add(key)
                        new[key] = lines[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(new, np.uint64, len(new)).view(np.int64)), pa.array(list(new.values()), pa.string())], names=["id", "content"])

    sought = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    lines = documents.select("text").mapInArrow(cut, "id long, content string").join(sought, "id", "left_semi")
    return stage(lines.dropDuplicates(["id"]), "lines-texts", "zstd")


def shingle_set(text: str, chars: int) -> set[str]:
    return {text[i:i + chars] for i in range(max(1, len(text) - chars + 1))}


def jaccard_test(lines: DataFrame, facts: DataFrame, chars: int, percent: int):
    """The pairs (a, b) of line ids whose shingle sets are similar.

    Sizes and sketches tell which pairs cannot be, so that few texts are moved; those are compared, not signatures.
    """

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(column(batch, n).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for n in ("a_sketch", "b_sketch"))
            near = pa.array((left == right).sum(axis=1) >= AGREE_HUB)
            yield pa.RecordBatch.from_arrays([column(batch, n).filter(near) for n in ("a", "b")], names=["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            kept, left, right = [], column(batch, "a_text").to_pylist(), column(batch, "b_text").to_pylist()
            looked = [compared(left[k:k + PAIRS], right[k:k + PAIRS], chars, percent) for k in range(0, len(left), PAIRS)]
            likely, certain = (np.concatenate(x) for x in zip(*looked)) if looked else (np.zeros(0, dtype=bool),) * 2
            kept.extend(np.flatnonzero(certain).tolist())
            for i in np.flatnonzero(likely & ~certain).tolist():
                a, b = left[i], right[i]
                if a != last:
                    last, last_set = a, shingle_set(a, chars)
                other = shingle_set(b, chars)
                common = len(last_set & other)
                if 100 * common >= percent * (len(last_set) + len(other) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([column(batch, n).take(pa.array(kept, pa.int32())) for n in ("a", "b")], names=["a", "b"])

    def test(pairs: DataFrame) -> DataFrame:
        spark = facts.sparkSession
        both = pairs.join(facts.toDF("a", "a_n", "a_sketch"), "a").join(facts.toDF("b", "b_n", "b_sketch"), "b")
        both = both.where(100 * (F.least("a_n", "b_n") + SLACK) >= percent * (F.greatest("a_n", "b_n") - SLACK))
        near = stage(both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(agree, "a long, b long"), "lines-near")
        drop_finished_shuffles(spark)
        left, right = lines.toDF("a", "a_text"), lines.toDF("b", "b_text")
        found = stage(near.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long"), "lines-found")
        discard(near)
        return found

    return test


def block_test(lines: DataFrame, facts: DataFrame, chars: int, percent: int):
    """Links that connect similar lines inside groups (hub, id, part), between parts not connected so far.

    A first pass over the blocks, with sizes and sketches, finds the lines that a line of another part may be
    similar to; only those meet again with their texts.
    """

    def candidates(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of the two blocks (or of the one) from different parts that may be similar."""
        side = group["side"]
        alone = group["i"][0] == group["j"][0]
        left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        n, part = group["n"].astype(np.int64), group["part"]
        near = 100 * (np.minimum(n[left, None], n[right]) + SLACK) >= percent * (np.maximum(n[left, None], n[right]) - SLACK)
        near &= part[left, None] != part[right]
        if alone:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        if not len(x):
            return x, y
        sketch = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(side), -1)
        agree = np.concatenate([(sketch[x[k:k + PAIRS]] == sketch[y[k:k + PAIRS]]).sum(axis=1) >= AGREE for k in range(0, len(x), PAIRS)])
        return x[agree], y[agree]

    def hope(group: dict[str, np.ndarray]) -> list[tuple]:
        places = np.unique(np.concatenate(candidates(group)))
        return list(zip(group["hub"][places].tolist(), group["id"][places].tolist(), group["part"][places].tolist()))

    def meet(group: dict[str, np.ndarray]) -> list[tuple]:
        (x, y), texts, part = candidates(group), group["content"], group["part"]
        looked = [compared(texts[x[k:k + PAIRS]].tolist(), texts[y[k:k + PAIRS]].tolist(), chars, percent) for k in range(0, len(x), PAIRS)]
        if not looked:
            return []
        likely, certain = (np.concatenate(x) for x in zip(*looked))
        top, join = united(part.tolist())
        ids, sets, found = group["id"].tolist(), {}, []
        for a, b, sure in zip(x[likely].tolist(), y[likely].tolist(), certain[likely].tolist()):
            if top(int(part[a])) == top(int(part[b])):
                continue
            if not sure:
                own, other = (sets[k] if k in sets else sets.setdefault(k, shingle_set(texts[k], chars)) for k in (a, b))
                common = len(own & other)
            if sure or 100 * common >= percent * (len(own) + len(other) - common):
                join(int(part[a]), int(part[b]))
                found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return found

    def rest(groups: DataFrame) -> DataFrame:
        open_rows = per_pair(blocks(groups, "lines"), [facts], hope, "hub long, id long, part long", LOT_ROWS, "lines")
        open_rows = stage(open_rows.distinct(), "lines-open")
        ids = stage(open_rows.select("id").distinct(), "lines-ids")
        few = stage(lines.join(ids, "id", "left_semi"), "lines-few", "zstd")
        drop_finished_shuffles(facts.sparkSession)
        found = per_pair(blocks(open_rows, "lines"), [facts, few], meet, "a long, b long", LOT_ROWS, "lines")
        discard(open_rows, ids, few)
        return found

    return rest


def dropped_lines(documents: DataFrame, chars: int = CHARS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All non-blank lines (doc_id, text_id, line, id) and those of them to drop, with their component.

    Of each component of equal or similar lines the first by doc_id, then by place, stays. Rows that share a
    doc_id are told apart by a hash of their texts.
    """
    whole = stage(sign_lines(documents, chars), "lines-signed", "zstd")
    known = whole.where("n is not null")
    signed = stage(whole.select("doc_id", "text_id", "line", "id"), "lines-placed")
    buckets = line_buckets(known)
    involved = stage(buckets.select("id").distinct(), "lines-involved")
    drop_finished_shuffles(documents.sparkSession)
    facts = stage(known.select("id", "n", "sketch").join(involved, "id", "left_semi").dropDuplicates(["id"]), "lines-facts")
    # From here on only the places of lines are needed besides.
    discard(whole)
    drop_finished_shuffles(documents.sparkSession)
    lines = line_texts(documents, involved)
    drop_finished_shuffles(documents.sparkSession)
    parts = stage(link(buckets, jaccard_test(lines, facts, chars, percent), block_test(lines, facts, chars, percent), "lines"), "lines-components")
    discard(buckets, facts, involved, lines)
    classes = signed.groupBy("id").agg(F.min(F.struct("doc_id", "line", "text_id")).alias("first"), F.count("*").alias("n"))
    classes = stage(classes.join(parts.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null")
                    .select("id", F.coalesce("component", "id").alias("component"), "first"), "lines-classes")
    keep = stage(classes.groupBy("component").agg(F.min("first").alias("keep")), "lines-keep")
    places = stage(classes.join(keep, "component").select("id", "component", "keep"), "lines-places")
    repeated = signed.join(places, "id")
    drop = repeated.where(~F.struct("doc_id", "line", "text_id").eqNullSafe(F.col("keep"))).select("doc_id", "text_id", "line", "component")
    return signed, drop


def dedup_lines(documents: DataFrame, chars: int = CHARS, percent: int = PERCENT) -> DataFrame:
    """`documents` without repeated or similar lines; documents that lose every line go, too.

    Lines end at newlines and are compared without the blanks around them; blank lines stay, and so do
    documents that have no other lines, NULL texts and rows with a NULL id. Rows that share a doc_id are documents
    of their own unless their texts are equal, too: fully repeated rows lose the same lines. A very long line is
    one line. Columns of any other name are kept as they are; n_chars, where present, follows the text.
    """
    _, drop = dropped_lines(documents.where("doc_id is not null"), chars, percent)
    lost = stage(drop.groupBy(F.col("doc_id").alias(_DOC), F.col("text_id").alias(_TEXT)).agg(F.collect_set("line").alias(_LOST)), "lines-lost")
    joined = documents.join(lost, (F.col("doc_id").cast("long") == F.col(_DOC)) & (F.xxhash64("text") == F.col(_TEXT)), "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(_LOST, i))
    new = joined.withColumn("text", F.when(F.col(_LOST).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    new = new.where(F.col(_LOST).isNull() | (F.trim(F.col("text"), F.lit(" \t\r\n")) != ""))
    if "n_chars" in documents.columns:
        new = new.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return new.select(*[F.col(f"`{c}`") for c in documents.columns])


def op2_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lines (not blank), kept, dropped (their numbers), of every document; repeated ids once for each text."""
    documents = read(spark, folder, "documents").where("doc_id is not null")
    _, drop = dropped_lines(documents)
    key = ["doc_id", "text_id"]
    marked = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")).cast("long")
    every = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), F.when(F.col("text").isNull(), 0).otherwise(marked).alias("lines")).distinct()
    lost = drop.groupBy(*key).agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    found = every.join(lost, key, "left")
    return found.select(
        "doc_id", "lines", (F.col("lines") - F.coalesce(F.size("dropped"), F.lit(0))).alias("kept"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
