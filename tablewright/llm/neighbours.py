"""Nearest neighbours by inner product: a forest of random-projection trees, then exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import column, read
from tablewright.sources.staging import stage

NEIGHBOURS = 20
TREES = 16
#: Vectors the trees' splits are fitted on at most (in expectation; by a hash of the id). All vectors are indexed.
FIT_VECTORS = 65_536
#: Fitted vectors of a leaf, about.
LEAF = 64
#: Points looked at for a query, as a share of all, counting a point once for each tree that leads to it.
#: Vectors without any structure need this much for a recall above 0.9; clustered ones far less.
SHARE = 0.9
#: Points that one scoring task holds; a part of a tree with more is cut into several.
CELL = 16_384
#: Queries scored together against a leaf.
BLOCK = 512


class Forest:
    """Perfect binary trees: node i of a tree has the children 2i+1 and 2i+2; splits at the median of the fitted vectors."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1.0, len(sample) / leaf)))))
        self.trees, self.leaves, inner = trees, 1 << self.depth, (1 << self.depth) - 1
        self.normals = draw.normal(size=(trees, inner, sample.shape[1] if sample.ndim == 2 else 0)).astype(np.float32)
        self.cuts = np.zeros((trees, inner), dtype=np.float32)
        for t in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            for i in range(inner):
                rows = np.flatnonzero(node == i)
                if not len(rows):
                    continue
                at = sample[rows] @ self.normals[t, i]
                self.cuts[t, i] = np.median(at)
                node[rows] = 2 * i + 1 + (at >= self.cuts[t, i])
        length = np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.normals /= np.maximum(length, 1e-30)
        self.cuts /= np.maximum(length[:, :, 0], 1e-30)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf (vectors x trees) each vector falls into."""
        out = np.zeros((len(vectors), self.trees), dtype=np.int64)
        for t in range(self.trees):
            side = vectors @ self.normals[t].T >= self.cuts[t] if self.depth else None
            node = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(vectors)), node]
            out[:, t] = node - (self.leaves - 1)
        return out

    def queue(self, vectors: np.ndarray) -> np.ndarray:
        """How far (vectors x trees*leaves) a query is on the wrong side on the way to a leaf, at most.

        A queue shared by all trees that always follows the branch with the least such distance
        reaches leaves in the order of these values.
        """
        far = np.zeros((len(vectors), self.trees, 1), dtype=np.float32)
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            margin = np.einsum("qd,tnd->qtn", vectors, self.normals[:, nodes]) - self.cuts[:, nodes]
            pair = np.stack([np.maximum(far, np.maximum(margin, 0)), np.maximum(far, np.maximum(-margin, 0))], axis=3)
            far = pair.reshape(len(vectors), self.trees, -1)
        return far.reshape(len(vectors), -1)


def matrix(values: pa.Array) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.float32) if len(values) else np.zeros((0, 0), dtype=np.float32)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that makes all vectors equally long, so that the nearest by angle has the largest product."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors.astype(np.float64) ** 2).sum(axis=1), 0))
    return np.column_stack([vectors, rest.astype(np.float32)]) / np.float32(longest)


def nearest(vectors: DataFrame, query_every: int = 20, k: int = NEIGHBOURS, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """The `k` vectors with the largest inner product for each row of `vectors` (vec_id, embedding) whose id `query_every` divides.

    Returns query_id, rank, vec_id, score (double precision over the original components); ties go to
    the smaller id; a query is never its own neighbour. Rows without an id, and vectors that are NULL,
    empty, zero, of another length than most or hold NULL or non-finite components, take no part.
    Repeated ids count once (the largest vector in array order). Equal vectors are searched and indexed once,
    with the k + 1 smallest ids they have, and every query of them gets the result.
    """
    spark = vectors.sparkSession
    usable = (vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
              .where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
              .where(F.exists("embedding", lambda x: x != 0))
              .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
              .groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    usable = stage(usable.withColumn("width", F.size("embedding")).withColumn("same", F.xxhash64("embedding")), "ann-vectors")
    widths = usable.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    usable = usable.where(F.col("width") == widths[0]["width"]).drop("width")
    # Of equal vectors only the k + 1 smallest ids can be among the nearest of anything.
    place = F.row_number().over(Window.partitionBy("same", "embedding").orderBy("vec_id"))
    least = usable.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = stage(least.groupBy("same", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                    .withColumn("class_id", F.col("ids")[0]), "ann-classes")
    totals = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("longest")).first()
    n, longest = totals["n"], float(np.sqrt(totals["longest"])) * (1 + 1e-6)
    draw = F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)) < int(min(1.0, FIT_VECTORS / n) * (1 << 30))
    fitted = matrix(pa.chunked_array([b.column(0) for b in classes.where(draw).select("class_id", "embedding").orderBy("class_id")
                                      .select("embedding").toArrow().to_batches()] or [pa.array([], pa.list_(pa.float32()))]))
    if not len(fitted):
        fitted = matrix(pa.chunked_array(classes.limit(1).select("embedding").toArrow().column(0).chunks))
    forest = spark.sparkContext.broadcast(Forest(lifted(fitted, longest), trees, LEAF))
    # Parts of trees: the leaves of one top branch, at most about CELL points, or slices of the points of one leaf.
    leaves = forest.value.leaves
    parts = min(leaves, 1 << max(0, int(np.ceil(np.log2(max(1.0, n / CELL))))))
    per_part = leaves // parts
    slices = max(1, -(-n // (leaves * CELL)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                leaf = own.leaf_of(lifted(matrix(column(rows, "embedding")), longest))
                for t in range(own.trees):
                    cell = (t * parts + leaf[:, t] // per_part) * slices + column(rows, "class_id").to_numpy() % slices
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(leaf[:, t] % per_part), column(rows, "class_id"), column(rows, "embedding")],
                        names=["cell", "leaf", "class_id", "embedding"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = forest.value, n / leaves
        most = min(own.trees * own.leaves, max(1, int(np.ceil(max(share * n, 400.0 * k) / size))))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                ids, vector = column(rows, "class_id").to_pylist(), column(rows, "embedding").to_pylist()
                order = np.argsort(own.queue(lifted_query(matrix(column(rows, "embedding")))), axis=1, kind="stable")[:, :most]
                out: tuple[list, ...] = ([], [], [], [])
                for i, places in enumerate(order):
                    part, leaf = np.divmod(np.sort(places), per_part)
                    cut = np.flatnonzero(np.diff(part)) + 1
                    for cell, group in zip(part[np.concatenate(([0], cut))], np.split(leaf, cut)):
                        for s in range(slices):
                            for values, value in zip(out, (int(cell) * slices + s, ids[i], vector[i], group.astype(np.int32))):
                                values.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float32())),
                     pa.array(out[3], pa.list_(pa.int32()))], names=["cell", "query", "vector", "leaves"])

    def score(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(points) and len(asked):
            points = points.sort_values("leaf", kind="stable")
            leaf, ids = points["leaf"].to_numpy(), points["class_id"].to_numpy()
            data = np.stack(points["embedding"].to_numpy()).astype(np.float64)
            first = np.searchsorted(leaf, np.arange(per_part + 1))
            for at in range(0, len(asked), BLOCK):
                block = asked.iloc[at:at + BLOCK]
                queries, own = np.stack(block["vector"].to_numpy()).astype(np.float64), block["query"].to_numpy()
                seen = [np.concatenate([np.arange(first[x], first[x + 1]) for x in group]) for group in block["leaves"]]
                for i, rows in enumerate(seen):
                    if not len(rows):
                        continue
                    value = data[rows] @ queries[i]
                    if len(rows) > k + 1:
                        # Ties with the last kept stay, too; the final ranking decides by id.
                        top = np.partition(value, len(value) - k - 1)[len(value) - k - 1]
                        rows, value = rows[value >= top], value[value >= top]
                    found.append(pd.DataFrame({"query": own[i], "class_id": ids[rows], "score": value}))
        return pd.concat(found) if found else pd.DataFrame({"query": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def lifted_query(queries: np.ndarray) -> np.ndarray:
        length = np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-30)
        return np.column_stack([queries / length, np.zeros(len(queries), dtype=np.float32)]).astype(np.float32)

    indexed = classes.select("class_id", "embedding").mapInArrow(route, "cell long, leaf long, class_id long, embedding array<float>")
    queries = usable.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    asked = queries.groupBy("same", "embedding").agg(F.min("vec_id").alias("lowest"))
    asked = stage(asked.join(classes, ["same", "embedding"]).select("class_id", "embedding"), "ann-queries")
    spread = asked.repartition(max(1, min(spark.sparkContext.defaultParallelism, asked.count() // 32)))
    visits = spread.mapInArrow(visit, "cell long, query long, vector array<float>, leaves array<int>")
    scored = indexed.groupBy("cell").cogroup(visits.groupBy("cell")).applyInPandas(score, "query long, class_id long, score double")
    # k + 1 classes hold the k nearest others, as a query's own class may be among them; ties stay until ids decide.
    best = scored.groupBy("query", "class_id").agg(F.max("score").alias("score"))
    best = best.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1)
    near = stage(best.join(classes.select("class_id", "ids"), "class_id")
                 .select(F.col("query").alias("class_id"), F.explode("ids").alias("vec_id"), "score"), "ann-near")
    each = (near.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")))
            .where(F.col("place") <= k + 1).groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")))
    each = stage(each.join(classes.select("class_id", "same", "embedding"), "class_id"), "ann-result")
    ranked = (queries.select(F.col("vec_id").alias("query_id"), "same", "embedding").join(each, ["same", "embedding"])
              .select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
              .select("query_id", F.posexplode("near").alias("at", "x")))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(read(spark, folder, "embeddings"))
