"""Vector codes: four codebooks of whole numbers, fitted by rounds whose distances are mostly ruled out by norm-of-sum bounds.

Each part of a vector keeps an upper bound of the distance to its entry and, for each group of
entries, a lower bound of the distance to the group's other entries, each with the round it was
measured in. All codebooks so far are at hand, so a bound is moved on by the true net displacement
of the entries between that round and now, which is never more than the sum of their drifts round
by round. Only parts and groups whose bounds leave doubt are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import column, read
from tablewright.llm.vectors import finite_vectors, largest, whole
from tablewright.sources.staging import spread, stage

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries of a group, which share a lower bound.
GROUP = 16
#: Rows worked on at once inside a task.
ROWS = 4096
#: Relative slack of bounds, far above the rounding of their arithmetic; ties are always compared exactly.
SLACK = 1e-5
#: Rows of a label are dealt to so many keys when its error is added up and joined.
SALTS = 64
_STATE = "vec_id long, label {label}, x array<long>, state binary"


def state_type(groups: int) -> np.dtype:
    """What a vector carries from round to round: code, bounds and the rounds they were measured in, entries compared so far."""
    return np.dtype([("code", "u1", PARTS), ("upper", "f4", PARTS), ("upper_at", "u1", PARTS),
                     ("lower", "f4", (PARTS, groups)), ("lower_at", "u1", (PARTS, groups)), ("compared", "<i8")])


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of whole numbers."""
    width, most = max(1, x.shape[1]), largest(x) + largest(entries)
    if width * most * most >= 1 << 63:
        raise OverflowError("a squared distance does not fit into a long")
    if 2 * width * most * most < 1 << 53:  # products and sums are exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def net_displacement(history: list[np.ndarray]) -> np.ndarray:
    """How far each entry of each part lies now from where it was (rounds x parts x entries); history: parts x entries x width each."""
    now = history[-1].astype(np.float64)
    return np.stack([np.sqrt(((now - then) ** 2).sum(axis=2)) for then in history]) * (1 + SLACK)


def start(x: np.ndarray, codebook: np.ndarray, groups: int) -> np.ndarray:
    """State after the first, exhaustive assignment of `x` (rows x parts x width)."""
    state = np.zeros(len(x), dtype=state_type(groups))
    everything = np.ones((len(x), groups), dtype=bool)
    for p in range(PARTS):
        far = np.full(len(x), np.iinfo(np.int64).max)
        _rescan(state, x[:, p], codebook[p], p, 0, everything, far, np.zeros(len(x), dtype=np.int64))
    return state


def advance(state: np.ndarray, x: np.ndarray, history: list[np.ndarray], moved: np.ndarray) -> None:
    """Assigns `x` to the last codebook of `history`, with distances only where bounds leave doubt."""
    now, groups = len(history) - 1, state["lower"].shape[2]
    entries = history[-1].shape[1]
    starts = np.arange(0, entries, GROUP)
    for p in range(PARTS):
        code = state["code"][:, p].astype(np.int64)
        upper = state["upper"][:, p] + moved[state["upper_at"][:, p], p, code]
        drift = np.maximum.reduceat(moved[:, p], starts, axis=1)  # rounds x groups
        lower = state["lower"][:, p] - drift[state["lower_at"][:, p], np.arange(groups)]
        unsure = np.flatnonzero(lower.min(axis=1) <= upper)
        if not len(unsure):
            continue
        # The exact distance to the own entry rules out more groups.
        own = ((x[unsure, p] - history[-1][p][code[unsure]]) ** 2).sum(axis=1)
        state["compared"][unsure] += 1
        upper = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        part = state[unsure]
        part["upper"][:, p], part["upper_at"][:, p] = upper, now
        open_groups = lower[unsure] <= upper[:, None]
        if open_groups.any():
            _rescan(part, x[unsure, p], history[-1][p], p, now, open_groups, own, code[unsure], lower[unsure])
        state[unsure] = part


def _rescan(state: np.ndarray, x: np.ndarray, entries: np.ndarray, p: int, now: int, open_groups: np.ndarray,
            own: np.ndarray, code: np.ndarray, lower: np.ndarray | None = None) -> None:
    """Compares rows with every entry of their open groups; new code (ties to the lower index), bounds and stamps.

    `own` is the exact squared distance to `code`; `lower` holds the bounds moved on to now.
    """
    best, best_code = own.copy(), code.copy()
    first, second, at = {}, {}, {}
    none = np.iinfo(np.int64).max
    for g in range(open_groups.shape[1]):
        rows = np.flatnonzero(open_groups[:, g])
        if not len(rows):
            continue
        own_entries = entries[g * GROUP:(g + 1) * GROUP]
        far = squared(x[rows], own_entries)
        state["compared"][rows] += len(own_entries)
        at[g] = far.argmin(axis=1)  # the lowest index of equal ones
        first[g] = far[np.arange(len(rows)), at[g]]
        far[np.arange(len(rows)), at[g]] = none
        second[g] = far.min(axis=1)
        at[g] += g * GROUP
        better = (first[g] < best[rows]) | (first[g] == best[rows]) & (at[g] < best_code[rows])
        best[rows[better]], best_code[rows[better]] = first[g][better], at[g][better]
    for g, least in first.items():
        rows = np.flatnonzero(open_groups[:, g])
        # The nearest of the group's entries that the part is not assigned to.
        other = np.where(at[g] == best_code[rows], second[g], least)
        bound = np.where(other == none, np.inf, np.sqrt(other.astype(np.float64)) * (1 - SLACK))
        state["lower"][rows, p, g], state["lower_at"][rows, p, g] = bound, now
    if lower is not None:
        # A left entry that was not compared with its group still bounds that group.
        group = code // GROUP
        left = np.flatnonzero((best_code != code) & ~open_groups[np.arange(len(code)), group])
        bound = np.minimum(lower[left, group[left]], np.sqrt(own[left].astype(np.float64)) * (1 - SLACK))
        state["lower"][left, p, group[left]], state["lower_at"][left, p, group[left]] = bound, now
    state["code"][:, p] = best_code
    state["upper"][:, p], state["upper_at"][:, p] = np.sqrt(best.astype(np.float64)) * (1 + SLACK), now


def unpacked(batch: pa.RecordBatch, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """State and vectors (rows x parts x width of a part) of a batch."""
    packed = b"".join(column(batch, "state").to_pylist())
    x = column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PARTS, width)
    return np.frombuffer(packed, dtype=state_type(groups)).copy(), x


def repacked(batch: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
    size = state.dtype.itemsize
    ends = pa.py_buffer(np.arange(0, (len(state) + 1) * size, size, dtype=np.int32))
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(state), [None, ends, pa.py_buffer(state.tobytes())])
    return pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("vec_id", "label", "x")), packed], names=["vec_id", "label", "x", "state"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def codebook_of(spark: SparkSession, assigned: DataFrame, last: np.ndarray, groups: int) -> np.ndarray:
    """Componentwise floor of the mean of the parts assigned to each entry; an entry without parts stays.

    Each task adds up its rows; what reaches the driver is one codebook.
    """
    parts, entries, width = last.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in pieces(batches):
            state, x = unpacked(batch, groups, width)
            for p in range(parts):
                place = p * entries + state["code"][:, p].astype(np.int64)
                np.add.at(sums, place, x[:, p])
                counts += np.bincount(place, minlength=len(counts))
        used = np.flatnonzero(counts)
        place = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(place[0]), pa.array(place[1]), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], width))],
                                         names=["entry", "place", "total", "n"])

    totals = assigned.mapInArrow(add, "entry long, place long, total long, n long").groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = totals.toArrow()
    new = last.reshape(parts * entries, width).copy()
    new[found["entry"].to_numpy(), found["place"].to_numpy()] = found["total"].to_numpy() // found["n"].to_numpy()
    return new.reshape(last.shape)


def fit_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, compared of every usable vector, and the final codebooks (parts x entries x width).

    `compared` is the number of entries a vector was compared with, over all parts and rounds; without
    bounds it would be parts * entries * (rounds + 1). See `vector_codes` for what is usable.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    usable = spread(finite_vectors(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    longest = usable.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // PARTS)
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    label = vectors.schema["label"].dataType.simpleString()
    if not first.num_rows:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, compared long"), np.zeros((PARTS, 0, width), dtype=np.int64)
    seeds = whole(first.column("embedding"), PARTS * width).reshape(-1, PARTS, width)
    history = [np.ascontiguousarray(seeds.transpose(1, 0, 2))]
    groups = -(-len(seeds) // GROUP)

    def begin(book):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                x = whole(column(batch, "embedding"), PARTS * width)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (PARTS * width)), pa.array(x.ravel()))
                known = pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "label"), flat], names=["vec_id", "label", "x"])
                yield repacked(known, start(x.reshape(len(x), PARTS, width), book.value[0], groups))

        return run

    def go_on(book):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved = net_displacement(book.value)
            for batch in pieces(batches):
                state, x = unpacked(batch, groups, width)
                advance(state, x, book.value, moved)
                yield repacked(batch, state)

        return run

    def finish(book):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                state, x = unpacked(batch, groups, width)
                error = sum(((x[:, p] - book.value[-1][p][state["code"][:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
                code = ["%02x%02x%02x%02x" % tuple(c) for c in state["code"].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "vec_id"), column(batch, "label"), pa.array(code, pa.string()), pa.array(error), pa.array(state["compared"])],
                    names=["vec_id", "label", "code", "error", "compared"])

        return run

    kind = _STATE.format(label=label)
    assigned = stage(usable.mapInArrow(begin(spark.sparkContext.broadcast(history)), kind), "codes-assigned")
    for _ in range(rounds):
        history.append(codebook_of(spark, assigned, history[-1], groups))
        assigned = stage(assigned.mapInArrow(go_on(spark.sparkContext.broadcast(list(history))), kind), "codes-assigned")
    out = assigned.mapInArrow(finish(spark.sparkContext.broadcast(history[-1:])), f"vec_id long, label {label}, code string, error long, compared long")
    return out, history[-1]


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, compared of every row of `vectors` (vec_id, embedding, label) that is usable.

    Components are whole numbers, floor(1024 x). Vectors that are NULL or hold NULL or non-finite
    components are left out. Shorter vectors, and lengths that four does not divide, are filled up with
    zeros. Rows with a NULL vec_id take part and come last where the first codebook is chosen; rows that
    repeat an id take part one by one, the smaller in array order first. Equal distances go to the lower
    index. With fewer rows than entries the codebooks have as many entries as rows. Other columns are
    ignored; an empty table gives no rows. Distances and sums beyond a long are errors.
    """
    rows, books = fit_codes(vectors, rounds, entries)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = stage(rows, "codes-rows").withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    # Labels are added up in two steps and joined by label and salt: one label may hold most rows.
    sums = rows.groupBy("label", "salt").agg(F.sum("error").alias("error")).groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("at")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "compared")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(read(spark, folder, "embeddings")).drop("compared")


def _sql() -> str:
    """The same by exhaustive comparison: a codebook and an assignment a round."""
    steps = [
        """v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "p as materialized (select vec_id, label, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] as x from v, (select unnest([0, 1, 2, 3]) as part))",
        "c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p qualify entry < 256)",
    ]
    for i in range(ROUNDS + 1):
        # Distance and index in one number: the least distance, then the lower index.
        steps.append(f"""a{i} as materialized (select p.vec_id, p.part, any_value(p.x) as x, any_value(p.label) as label, min(256 * cast(list_sum(list_transform(
  range(1, len(p.x) + 1), lambda k: (p.x[k] - c.x[k]) * (p.x[k] - c.x[k]))) as bigint) + c.entry) as best from p join c{i} c using (part) group by p.vec_id, p.part)""")
        if i < ROUNDS:
            steps.append(f"""s{i} as (select part, best % 256 as entry, k, cast(floor(sum(x[k]) / count(*)) as bigint) as mean
  from a{i}, (select unnest(range(1, (select max(len(x)) from p) + 1)) as k) group by all)""")
            steps.append(f"""c{i + 1} as materialized (select c.part, c.entry, coalesce(m.x, c.x) as x from c{i} c
  left join (select part, entry, list(mean order by k) as x from s{i} group by all) m using (part, entry))""")
    last = ROUNDS
    return "with " + ",\n".join(steps) + f""",
e as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best % 256), '' order by part) as code, cast(sum(best // 256) as bigint) as error
  from a{last} group by vec_id),
h as (select sha256(string_agg(cast(x[k] as varchar), ',' order by part, entry, k)) as codebooks_sha256
  from c{last}, (select unnest(range(1, (select max(len(x)) from p) + 1)) as k))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from e, h"""


OP11_SQL = _sql()
