"""Exact top-k search: sparse query rows scatter weighted postings into dense score arrays, term at a time.

A component's place is a term. A block of candidates is turned into postings, one list of
(candidate, weight) for each term; every term of a query adds its postings, times the query's
weight, to an array with one score for each candidate of the block. Selection keeps the k best of
each block and task; the tasks' lists are merged by a limited ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import column, read
from tablewright.llm.vectors import finite_vectors, largest, whole
from tablewright.sources.staging import stage

NEIGHBOURS = 10
QUERY_EVERY = 100
#: Components of the queries that one pass over the candidates carries to every task (16 MB); more queries take more passes.
QUERY_COMPONENTS = 1 << 21
#: Candidates of a block: their postings and score arrays stay in a processor's cache.
BLOCK = 8192
_FOUND = "query_id long, vec_id long, score long"


def postings(x: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per term the candidates that have it and their weights; a slice where all have it."""
    lists = []
    for term in range(x.shape[1]):
        rows = np.flatnonzero(x[:, term])
        weights = np.ascontiguousarray(x[rows, term])
        lists.append((slice(None) if len(rows) == len(x) else rows, weights))
    return lists


def scores(terms: np.ndarray, weights: np.ndarray, lists: list, size: int) -> np.ndarray:
    """Scores of all candidates of a block for one sparse query row."""
    out = np.zeros(size, dtype=np.int64)
    for term, weight in zip(terms.tolist(), weights.tolist()):
        rows, values = lists[term]
        out[rows] += weight * values
    return out


class Best:
    """The k best (score, id) of each query seen so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = [np.zeros(0, dtype=np.int64)] * len(queries)
        self.ids = [np.zeros(0, dtype=np.int64)] * len(queries)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        known = self.score[i]
        rows = np.flatnonzero(score >= known[-1]) if len(known) == self.k else np.arange(len(score))
        rows = rows[ids[rows] != self.queries[i]]
        if not len(rows):
            return
        if len(rows) > self.k:
            # Ties with the last kept stay; the order by id decides on them.
            rows = rows[score[rows] >= np.partition(score[rows], len(rows) - self.k)[len(rows) - self.k]]
        both, names = np.concatenate((known, score[rows])), np.concatenate((self.ids[i], ids[rows]))
        order = np.lexsort((names, -both))[:self.k]
        self.score[i], self.ids[i] = both[order], names[order]


def top_k(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = NEIGHBOURS, query_components: int = QUERY_COMPONENTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows of `vectors` (vec_id, embedding) with the largest integer inner product.

    Queries are the rows whose id `query_every` divides, candidates all rows with another id; every
    candidate is scored. Ties go to the smaller id. Rows without an id, and vectors that are NULL or
    hold NULL or non-finite components, take no part; empty and zero vectors do, with score 0. Of
    vectors of different lengths the shorter one counts as filled up with zeros. Rows that repeat an
    id are candidates one by one; the largest of their vectors in array order asks. Scores beyond a
    long are an OverflowError. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = finite_vectors(vectors).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asking = stage(usable.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.max("embedding").alias("embedding")), "topk-queries")
    width = asking.agg(F.max(F.size("embedding"))).first()[0] or 0
    several = max(1, query_components // max(1, width))
    found, after = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), None
    while True:
        rest = asking if after is None else asking.where(F.col("vec_id") > after)
        rows = rest.orderBy("vec_id").limit(several).toArrow()
        if not rows.num_rows:
            return found
        after = rows.column("vec_id")[-1].as_py()
        queries = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), whole(rows.column("embedding"), width)))
        best = usable.mapInArrow(_scan(queries, k), _FOUND)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        ranked = best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = found.unionByName(stage(ranked, "topk-found"))


def _scan(queries, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = queries.value
        terms = [np.flatnonzero(row) for row in matrix]
        weights = [row[t] for row, t in zip(matrix, terms)]
        best, width, most = Best(ids, k), matrix.shape[1], largest(matrix)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                x, names = whole(column(block, "embedding"), width), column(block, "vec_id").to_numpy()
                if most * largest(x) * max(1, width) >= 1 << 63:
                    raise OverflowError("a score does not fit into a long")
                lists = postings(x)
                for i in range(len(ids)):
                    best.add(i, scores(terms[i], weights[i], lists, len(names)), names)
        counts = [len(x) for x in best.ids]
        if sum(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score))],
                names=["query_id", "vec_id", "score"])

    return scan


def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(read(spark, folder, "embeddings"))


OP13_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
  cast(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""
