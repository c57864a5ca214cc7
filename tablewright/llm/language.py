"""Language proportions of documents: expectation-maximisation over character n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import chunks, column, fold, read, texts_of

#: Documents per language that the models are fitted on at most (in expectation; chosen by a hash of the id).
FIT_DOCUMENTS = 4_000
#: Character trigrams are counted in this many hashed cells.
CELLS = 1 << 15
#: Weight, in trigrams, of the pooled distribution each model is smoothed with.
SMOOTHING = 2_000.0
UNDETERMINED = "und"
#: Languages the models may have; the table of models is this many columns wide at most.
MOST_LANGUAGES = 400
#: Trigrams taken as independent evidence per trigram seen; neighbouring trigrams share letters.
EVIDENCE = 1 / 3
FIRST_STEPS, STEPS = 8, 5
KNOWN_STEPS = 30


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and cell of every trigram whose middle is a letter, case folded, other signs as one blank."""
    joined = "\n" + "\n\n".join(x.lower() for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(x.lower()) for x in texts), dtype=np.int64, count=len(texts))
    letter = _letters()[codes]
    folded = np.where(letter, codes, np.uint32(0))
    middle = np.flatnonzero(letter)
    cells = folded[middle - 1] * np.uint32(0x9E3779B1) + folded[middle]
    cells *= np.uint32(0x85EBCA6B)
    cells += folded[middle + 1]
    cells *= np.uint32(0xC2B2AE35)
    cells ^= cells >> np.uint32(15)
    starts = np.concatenate(([0], np.cumsum(lengths + 2)))[:-1]
    return np.searchsorted(starts, middle, side="right") - 1, (cells % np.uint32(CELLS)).astype(np.int64)


def learn(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and the cell probabilities (cells x languages) of labelled `documents` (doc_id, text, lang).

    A language with more than `fit_documents` documents is fitted on about so many of them, taken
    by a hash of the id; the figures collected are bounded by cells x languages.
    """
    labelled = documents.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((CELLS, 0))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, fit_documents / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = {k: i for i, k in enumerate(names)}, np.zeros((len(names), CELLS), dtype=np.int64)
        for batch in batches:
            texts, langs = texts_of(batch), np.array([index[x] for x in column(batch, "lang").to_pylist()])
            for lo, hi in chunks(texts):
                doc, cell = trigram_cells(texts[lo:hi])
                sums += np.bincount(langs[lo:hi][doc] * CELLS + cell, minlength=sums.size).reshape(sums.shape)
        lang, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(sums[lang, cell], pa.int64())],
            names=["lang", "cell", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang int, cell int, n long")
    table = np.zeros((CELLS, len(names)))
    found = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table[found["cell"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    pooled = table.sum(axis=1, keepdims=True) + 1.0
    pooled /= pooled.sum()
    return names, (table + SMOOTHING * pooled) / (table.sum(axis=0) + SMOOTHING)


def mixtures(doc: np.ndarray, cell: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) by EM; languages whose removal the penalised likelihood favours are 0.

    The penalty per language is that of the Bayesian information criterion. Texts without
    letters have all-zero rows.
    """
    k = table.shape[1]
    keys, counts = np.unique(doc * CELLS + cell, return_counts=True)
    row, chance = keys // CELLS, table[keys % CELLS].astype(np.float32)
    weight = counts.astype(np.float32)
    texts, first = np.unique(row, return_index=True)
    shares = np.zeros((n, k))
    if not len(texts):
        return shares
    sizes = np.diff(np.append(first, len(row)))
    total = np.add.reduceat(weight, first)

    def em(prior: np.ndarray, steps: int, chance: np.ndarray, weight: np.ndarray, first: np.ndarray, sizes: np.ndarray,
           total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for step in range(steps + 1):
            joint = chance * np.repeat(prior, sizes, axis=0)
            mixed = joint.sum(axis=1)
            if step < steps:
                joint *= (weight / mixed)[:, None]
                prior = (np.add.reduceat(joint, first, axis=0) / total[:, None]).astype(np.float32)
        return prior, np.add.reduceat(weight * np.log(mixed), first)

    prior, value = em(np.full((len(texts), k), 1 / k, dtype=np.float32), FIRST_STEPS, chance, weight, first, sizes, total)
    left = np.arange(len(texts))
    parts = (chance, weight, first, sizes, total)
    while len(left):
        active = prior[left] > 0
        several = active.sum(axis=1) > 1
        if not several.all():
            left = left[several]
            if not len(left):
                break
        rows = np.repeat(np.isin(np.arange(len(texts)), left), sizes)
        own = sizes[left]
        parts = (chance[rows], weight[rows], np.concatenate(([0], np.cumsum(own)[:-1])), own, total[left])
        fewer = np.where(prior[left] > 0, prior[left], np.inf)
        trial = prior[left].copy()
        trial[np.arange(len(left)), fewer.argmin(axis=1)] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        trial, lower = em(trial, STEPS, *parts)
        better = EVIDENCE * (value[left] - lower) < 0.5 * np.log(np.maximum(total[left] * EVIDENCE, np.e))
        prior[left[better]], value[left[better]] = trial[better], lower[better]
        left = left[better]
    shares[texts] = prior
    return shares


def known_share(doc: np.ndarray, cell: np.ndarray, n: int, table: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Share of each text that its mixture explains, by EM against a background where all cells are alike; 0 without letters."""
    ratio = (table[cell] * shares[doc]).sum(axis=1) * CELLS
    sizes, known = np.maximum(np.bincount(doc, minlength=n), 1), np.full(n, 0.5)
    for _ in range(KNOWN_STEPS):
        joint = known[doc] * ratio
        known = np.bincount(doc, weights=joint / (joint + 1 - known[doc]), minlength=n) / sizes
    return known


def in_known_languages(documents: DataFrame, model: tuple[list[str], np.ndarray], least: float) -> DataFrame:
    """Rows of `documents` (text, any others) with a share of `least` or more in languages of the model, one or several.

    Each row is judged by its own text, whatever its other columns are; texts that are NULL or have no letter go.
    """
    names, table = model
    shared = documents.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = texts_of(batch), np.zeros(batch.num_rows, dtype=bool)
            if names:
                for lo, hi in chunks(texts):
                    found = trigram_cells(texts[lo:hi])
                    kept[lo:hi] = known_share(*found, hi - lo, shared.value, mixtures(*found, hi - lo, shared.value)) >= least
            yield batch.filter(pa.array(kept))

    return documents.mapInArrow(keep, documents.schema)


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, n_languages, proportions of every whole text of `documents` (doc_id, text).

    `lang_pred` is the language with the largest proportion (ties: the first by name), `score`
    that proportion. Texts that are NULL or have no letter, and all texts where nothing was
    learned, are `und` with score 0 and no proportions. Repeated rows give repeated rows.
    """
    names, table = model
    shared = documents.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            shares = np.zeros((len(texts), len(names)))
            if names:
                for lo, hi in chunks(texts):
                    shares[lo:hi] = mixtures(*trigram_cells(texts[lo:hi]), hi - lo, shared.value)
            best = shares.argmax(axis=1) if names else np.zeros(len(texts), dtype=np.int64)
            top = shares[np.arange(len(texts)), best] if names else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"),
                pa.array([names[b] if s > 0 else UNDETERMINED for b, s in zip(best, top)], pa.string()),
                pa.array(np.minimum(top, 1.0), pa.float64()),
                pa.array((shares > 0).sum(axis=1).astype(np.int32), pa.int32()),
                pa.array([[(k, float(v)) for k, v in zip(names, x) if v > 0] for x in shares], pa.map_(pa.string(), pa.float64())),
            ], names=["doc_id", "lang_pred", "score", "n_languages", "proportions"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double, n_languages int, proportions map<string,double>")


def held_out(doc_id: Column) -> Column:
    """Fold of documents whose lang is never learned; a NULL id is held out, too."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def learned(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    return learn(documents.where(~held_out(F.col("doc_id"))))


def op9_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return identify(documents, learned(documents)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_languages", "proportions")
