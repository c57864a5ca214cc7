"""Best-fit packing with large-item matching: documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm.common import column, read, texts_of
from tablewright.sources.staging import stage

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces packed together in one task; each such shard wastes less than one sequence.
SHARD_PIECES = 40_000
CACHED_WORDS = 800_000
LONGEST_CACHED = 40

#: Texts of these signs alone are cut here; letters, digits and signs among them are to `re` what they are to the tokenizer.
_COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
#: The pre-token pattern of the vocabulary file (fixed value) over those signs.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of
    its words in turn; words and pre-tokens recur, so their ids are kept. Texts with other
    signs than `_COMMON`, or with the start of a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()
            keep(self.pieces, piece, ids)
        return ids

    def _word(self, word: str) -> bytes:
        ids = b"".join([self._piece(x) for x in _PIECE.findall(word)])
        keep(self.words, word, ids)
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _COMMON.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        get, new = self.words.get, self._word
        plain = text if is_normalized("NFC", text) else normalize("NFC", text)
        return b"".join([new(w) if (ids := get(w)) is None else ids for w in plain.lower().split()])


def keep(known: dict[str, bytes], text: str, ids: bytes) -> None:
    if len(known) >= CACHED_WORDS:
        known.clear()
    if len(text) <= LONGEST_CACHED:
        known[text] = ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by `end_id`."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch)):
                ids = own.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for values, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1..capacity).

    Above a third of the capacity at most two fit a bin: the largest left takes the largest
    that still fits beside it. The others go, longest first, into the tightest gap that
    takes them. Sets of lengths and gaps are bits of one integer, so that finding the next
    one takes no search.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    n_large = sum(3 * s > capacity for s in sizes)
    waiting: dict[int, list[int]] = {}
    for i in range(n_large - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    lengths_left = sum(1 << s for s in waiting)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    gaps: dict[int, list[int]] = {}
    used: list[int] = []
    gap_bits = 0

    def take(size: int) -> int:
        nonlocal lengths_left
        row = waiting[size].pop()
        if not waiting[size]:
            lengths_left &= ~(1 << size)
        return row

    def put(bin_: int) -> None:
        nonlocal gap_bits
        if gap := capacity - used[bin_]:
            gaps.setdefault(gap, []).append(bin_)
            gap_bits |= 1 << gap

    while lengths_left:
        size = lengths_left.bit_length() - 1
        row = take(size)
        bins[row] = len(used)
        filled = size
        if fitting := lengths_left & ((1 << (capacity - size + 1)) - 1):
            other = take(partner := fitting.bit_length() - 1)
            bins[other], offsets[other] = len(used), size
            filled += partner
        used.append(filled)
        put(len(used) - 1)
    for row in range(n_large, len(sizes)):
        size = sizes[row]
        if above := gap_bits >> size:
            gap = size + (above & -above).bit_length() - 1
            bin_ = gaps[gap].pop()
            if not gaps[gap]:
                gap_bits &= ~(1 << gap)
        else:
            used.append(0)
            bin_ = len(used) - 1
        bins[row], offsets[row] = bin_, used[bin_]
        used[bin_] += size
        put(bin_)
    out_bins, out_offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    out_bins[order], out_offsets[order] = bins, offsets
    return out_bins, out_offsets


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequence and offset of every piece of `documents` (doc_id, text; other columns are ignored).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A NULL or empty text is
    the end id alone; a NULL doc_id stays NULL; repeated rows are packed as often as they occur; an
    empty table gives no rows. Pieces are dealt to shards of `shard_pieces` by a hash of their place, so
    that no task holds more, however large the table or a group of copies is.
    """
    cut = stage(pieces(documents, path or public_tokenizers.path(TOKENIZER), capacity, end_id)
                .withColumn("place", F.monotonically_increasing_id()), "packing")
    shards = max(1, -(-cut.count() // shard_pieces))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        bins, offsets = fit(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["shard"].to_numpy(dtype=np.int64) << 32) + bins, offset=offsets)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return (cut.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
            .groupBy("shard").applyInPandas(
                place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))
