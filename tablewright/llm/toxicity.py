"""Toxic passages: maximum-scoring segments over word log-odds, rated by extreme-value statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import column, fold, read, texts_of
from tablewright.sources.staging import stage

#: Labelled documents the word scores and the calibration are fitted on at most (in expectation; by a hash of the id).
FIT_DOCUMENTS = 40_000
#: Words that get a score of their own: those with the largest |z|; all others share the neutral score.
MODEL_WORDS = 20_000
#: A word must occur in so many labelled documents to be scored.
LEAST_DOCUMENTS = 4
#: Words of prior weight that the corpus frequencies carry (Dirichlet).
PRIOR_WORDS = 20_000.0
LEAST_Z = 5.0
#: A segment is significant if fewer than so many are expected by chance in a text of its length.
SIGNIFICANT = 0.05
#: Evidence classes of the calibration.
BINS = 64
#: Letters of a word's stems, which are counted like words, so that unseen forms of a telling word count, too.
STEMS = (7, 5)
#: Words whose score or place a task keeps at hand.
KNOWN_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")

FEATURES = "doc_id long, words long, best double, segments int, total double, spans array<struct<start:int,stop:int,score:double>>"


def forms(word: str) -> list[str]:
    """The word, then its stems (marked `^`), longest first."""
    return [word] + ["^" + word[:k] for k in STEMS if len(word) > k]


def held_out(doc_id: Column) -> Column:
    """Fold of documents whose label is never learned; a NULL id is held out, too."""
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(True))


def sampled_labels(labels: DataFrame, fit_documents: int) -> DataFrame:
    """One row (doc_id, toxic 0/1) per learnable labelled document, about `fit_documents` at most."""
    usable = (labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    n = usable.count()
    share = min(1.0, fit_documents / max(n, 1))
    return usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))


def word_counts(documents: DataFrame, sample: DataFrame) -> pd.DataFrame:
    """word (or stem), different words of texts labelled 0 and 1 of that form.

    A word counts once a text, and copies of a text count once: else lines that a few documents
    repeat would seem telling.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(texts_of(batch), column(batch, "toxic").to_pylist()):
                for word in set(_WORD.findall(text.lower())):
                    for form in forms(word):
                        found.setdefault(form, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string())] + [pa.array([v[i] for v in found.values()], pa.int64()) for i in range(2)],
                names=["word", "clean", "toxic"])

    counted = (documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
               .withColumn("key", F.xxhash64("text")).dropDuplicates(["key", "toxic"]).drop("key")
               .mapInArrow(count, "word string, clean long, toxic long")
               .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counted = stage(counted, "toxic-words")
    sums = counted.where("word not like '^%'").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n0, n1 = float(sums["clean"] or 0), float(sums["toxic"] or 0)
    # A first ranking without the corpus prior picks the words worth scoring; it needs no second look at the texts.
    rate = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    z = rate / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    picked = (counted.where(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).withColumn("z", z)
              .orderBy(F.desc(F.abs("z")), "word").limit(MODEL_WORDS).toPandas())
    picked.attrs.update(clean=n0, toxic=n1)
    return picked


def corpus_counts(documents: DataFrame, words: list[str]) -> tuple[np.ndarray, float]:
    """How many texts of the whole table have each of `words`, each different word of a stem counted; and the sum over all words."""
    index = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (len(index) + 1)
        own: dict[str, list[int]] = {}
        for batch in batches:
            for text in texts_of(batch):
                found = set(_WORD.findall(text.lower()))
                sums[-1] += len(found)
                for word in found:
                    at = own.get(word)
                    if at is None:
                        if len(own) >= KNOWN_WORDS:
                            own.clear()
                        at = own[word] = [index[x] for x in forms(word) if x in index]
                    for i in at:
                        sums[i] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.array(sums)[at], pa.int64())], names=["word", "n"])

    found = documents.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(len(words) + 1)
    sums[found["word"].to_numpy()] = found["n"].to_numpy()
    return sums[:-1], float(sums[-1])


def log_odds(picked: pd.DataFrame, corpus: np.ndarray, corpus_words: float) -> pd.DataFrame:
    """word, score, z: log-odds of the toxic against the clean documents under a Dirichlet prior of corpus frequencies."""
    n0, n1 = picked.attrs["clean"], picked.attrs["toxic"]
    prior = PRIOR_WORDS * (corpus + 1) / max(corpus_words + len(corpus), 1.0)
    y1, y0 = picked["toxic"].to_numpy(dtype=float) + prior, picked["clean"].to_numpy(dtype=float) + prior
    score = np.log(y1 / (n1 + PRIOR_WORDS - y1)) - np.log(y0 / (n0 + PRIOR_WORDS - y0))
    z = score / np.sqrt(1 / y1 + 1 / y0)
    return pd.DataFrame({"word": picked["word"], "score": score, "z": z})


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) in one pass.

    Each positive run joins the nearest earlier segment that started lower and ended not
    higher; segments passed over on the way are swallowed. Running sums are kept, so that
    no score is added twice.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, start = sums[i], sums[i + 1], i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append([start, i + 1, low, high])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(h - l)) for a, b, l, h in found]


class Model:
    """Word scores and their chance statistics: lambda and K of the best segment's extreme-value distribution."""

    def __init__(self, words: dict[str, float], neutral: float, decay: float, scale: float):
        self.words, self.neutral, self.decay, self.scale = words, neutral, decay, scale


def fit_scores(odds: pd.DataFrame, picked: pd.DataFrame) -> tuple[dict[str, float], float, float]:
    """Scores, the neutral score and lambda.

    Only words that clearly speak for a label count; every other word costs as much as makes the
    mean score of clean text clearly negative, which segment statistics need. lambda solves
    sum(p * exp(lambda * score)) = 1 over the words of clean text.
    """
    kept = (odds["z"].abs() >= LEAST_Z) & (odds["score"].abs() > 0.2)
    words = dict(zip(odds["word"][kept], odds["score"][kept].clip(-4.0, 8.0)))
    chance = picked["clean"].to_numpy(dtype=float)[kept.to_numpy()] / max(picked.attrs["clean"], 1.0)
    scores = np.fromiter(words.values(), dtype=float, count=len(words))
    rest = max(1.0 - chance.sum(), 1e-9)
    neutral = -max(0.02, 2.0 * float((chance * np.maximum(scores, 0)).sum()) / rest)
    low, high = 1e-6, 1.0

    def over(x: float) -> float:
        return float((chance * np.exp(np.minimum(x * scores, 700))).sum() + rest * np.exp(x * neutral) - 1)

    if not (scores > 0).any() or not (chance[scores > 0] > 0).any():
        return words, neutral, 1.0
    while over(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) < 0 else (low, middle)
    return words, neutral, high


def features(documents: DataFrame, words: dict[str, float], neutral: float, decay: float, scale: float) -> DataFrame:
    """Words, best segment, and the significant segments (count, summed score, word spans) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared.value, {}

        def get(word: str) -> float:
            if (score := own.get(word)) is None:
                if len(own) >= KNOWN_WORDS:
                    own.clear()
                score = own[word] = next((model[x] for x in forms(word) if x in model), neutral)
            return score

        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text in texts_of(batch):
                scores = np.array([get(w) for w in _WORD.findall(text.lower())])
                found = segments(scores)
                best = max((s for _, _, s in found), default=0.0)
                chance = np.log(max(scale * len(scores), 1e-300))
                clear = [x for x in found if chance - decay * x[2] < np.log(SIGNIFICANT)]
                for values, value in zip(rows, (len(scores), best, len(clear), sum(x[2] for x in clear),
                                                [{"start": a, "stop": b, "score": s} for a, b, s in clear])):
                    values.append(value)
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id")] + [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.float64(), pa.int32(), pa.float64(), span))],
                names=["doc_id", "words", "best", "segments", "total", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, FEATURES)


def evidence(decay: float, scale: float) -> Column:
    """-log of the chance that a clean text of this length has a best segment as high (Gumbel), at most 60; 0 without words."""
    expected = scale * F.col("words") * F.exp(-decay * F.col("best"))
    return F.when((F.col("words") == 0) | (F.col("best") <= 0), 0.0).otherwise(
        F.least(F.lit(60.0), F.greatest(F.lit(0.0), -F.log(F.when(expected < 1e-6, expected).otherwise(1 - F.exp(-expected))))))


def rising(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing values (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def score_documents(documents: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Toxicity of every whole text of `documents` (doc_id, text), learned from `labels` (doc_id, toxic).

    Returns doc_id, held_out, score, predicted, evidence, segments, total, spans (word ranges of the
    significant passages). Rows whose id is NULL, whose label is not 0 or 1, or that are held out teach
    nothing; of several labels of one id the largest counts. Empty or NULL texts, and all texts
    where nothing could be learned, have no evidence and get the share of toxic documents among
    such. Word scores and calibration are fitted on about `fit_documents` labelled documents; the
    prior counts all words of all documents.
    """
    spark = documents.sparkSession
    sample = stage(sampled_labels(labels, fit_documents), "toxic-labels")
    picked = word_counts(documents, sample)
    corpus, corpus_words = corpus_counts(documents, picked["word"].tolist())
    words, neutral, decay = fit_scores(log_odds(picked, corpus, corpus_words), picked)
    # K by maximum likelihood over the clean labelled documents, whose best segments the first pass gives.
    first = features(documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample.where("toxic = 0").select("doc_id")), "doc_id"),
                     words, neutral, decay, 0.0)
    sums = first.where("words > 0").agg(F.count("*").alias("n"), F.sum(F.col("words") * F.exp(-decay * F.col("best"))).alias("mass")).first()
    scale = float(sums["n"]) / float(sums["mass"]) if sums["n"] and sums["mass"] else 1.0
    found = stage(features(documents, words, neutral, decay, scale).withColumn("evidence", evidence(decay, scale)), "toxic-features")
    # Evidence in the texts' significant passages together, in units of the best one's.
    strength = F.col("evidence") + F.log1p(F.col("total") * decay)
    cell = F.least(F.lit(BINS - 1), F.floor(strength * 2.0)).cast("int")
    counts = (found.select("doc_id", cell.alias("cell")).join(F.broadcast(sample), "doc_id").groupBy("cell")
              .agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas())
    n, toxic = np.zeros(BINS), np.zeros(BINS)
    n[counts["cell"].to_numpy(dtype=int)], toxic[counts["cell"].to_numpy(dtype=int)] = counts["n"], counts["toxic"]
    base = toxic.sum() / max(n.sum(), 1.0)
    chance = rising((toxic + base) / (n + 1.0), n + 1.0) if n.sum() else np.zeros(BINS)
    steps = F.array(*[F.lit(float(x)) for x in np.append(chance, chance[-1])])
    # Linear between cells and rising within a level one, so that more evidence is never scored lower or, short of the ceiling, alike.
    at = F.least(F.lit(float(BINS - 1)), strength * 2.0)
    low = steps[cell]
    score = F.least(F.lit(1.0), 0.999 * low + 0.001 * at / float(BINS))
    return (found.withColumn("score", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence", "segments", "total", "spans"))


def op1_toxicity_segments(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))
