"""Edit-aware token counts: segment trees over a document's pre-tokens, brought up to date edit by edit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm.common import column, read

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
KNOWN_PIECES = 400_000
#: Pre-tokens that a tree's leaf holds when it is built.
LEAF = 32
#: How many characters after a pre-token can decide where it ends (a contraction looks at three).
LOOKAHEAD = 3
#: Edits that the query makes in every document, as places in eighths of its length.
PLACES = (1, 3, 6)


class Counter:
    """Pre-tokens of a text and their token counts; a special token's string in a text is ordinary text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            if len(piece) <= 40:
                self.known[piece] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token."""
        pieces = self.pattern.findall(text)
        get, count = self.known.get, self.count
        return list(map(len, pieces)), [count(x) if (n := get(x)) is None else n for x in pieces]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """A document's pre-tokens in leaves, under a binary tree of summed characters and tokens.

    A leaf holds lists of its pre-tokens' characters and tokens, as many as its region came to have; trees
    change in leaves and in the sums on the way up only.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = [(chars[i:i + LEAF], tokens[i:i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.width)
        for i, (c, t) in enumerate(self.leaves):
            self.sums[self.width + i] = (sum(c), sum(t))
        for i in range(self.width - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character `at` (the last one that has any, past the end), and where the leaf starts."""
        node, start = 1, 0
        at = min(at, self.sums[1][0] - 1)
        while node < self.width:
            node *= 2
            if at >= start + self.sums[node][0]:
                start += self.sums[node][0]
                node += 1
        return max(0, min(node - self.width, len(self.leaves) - 1)), start

    def put(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        node = self.width + leaf
        self.sums[node] = (sum(chars), sum(tokens))
        while node > 1:
            node //= 2
            (a, b), (c, d) = self.sums[2 * node], self.sums[2 * node + 1]
            self.sums[node] = (a + c, b + d)

    def edit(self, text: str, at: int, drop: int, put: str, own: Counter) -> str:
        """Replaces `drop` characters at `at` by `put` and encodes anew from the pre-token before to where old bounds are met again."""
        at = max(0, min(at, len(text)))
        drop = max(0, min(drop, len(text) - at))
        new = text[:at] + put + text[at + drop:]
        if not drop and not put:
            return new
        if not text:
            self.__init__(*own.leaves(new))
            self.encoded += len(self.leaves)
            return new
        # The first pre-token that the edit, or characters it can see, may change.
        first, start = self.find(max(0, at - LOOKAHEAD - 1))
        chars, tokens = self.leaves[first]
        keep = 0
        while keep < len(chars) and start + chars[keep] + LOOKAHEAD < at:
            start += chars[keep]
            keep += 1
        shift = len(put) - drop
        # Old bounds after the edit, walked along as new pre-tokens are found.
        leaf, place, bound = first, keep, start
        found_chars, found_tokens, here = [], [], start
        matches = own.pattern.finditer(new, start)
        while True:
            while bound < max(here - shift, at + drop) and leaf < len(self.leaves):
                if place < len(self.leaves[leaf][0]):
                    bound += self.leaves[leaf][0][place]
                    place += 1
                else:
                    leaf, place = leaf + 1, 0
            if bound == here - shift and here >= at + len(put) and bound >= at + drop:
                break
            match = next(matches, None)
            if match is None:
                leaf, place = len(self.leaves), 0
                break
            found_chars.append(match.end() - match.start())
            found_tokens.append(own.count(match.group()))
            self.encoded += 1
            here = match.end()
        if leaf >= len(self.leaves):
            leaf, place = len(self.leaves) - 1, len(self.leaves[-1][0])
        rest = self.leaves[leaf][0][place:], self.leaves[leaf][1][place:]
        head = chars[:keep] + found_chars, tokens[:keep] + found_tokens
        if leaf == first:
            self.put(first, head[0] + rest[0], head[1] + rest[1])
        else:
            self.put(leaf, *rest)
            for between in range(first + 1, leaf):
                self.put(between, [], [])
            self.put(first, *head)
        return new


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """`documents` (doc_id, text) with chars and tokens: the pre-tokens' lengths and token counts, from which trees are built."""
    path = path or public_tokenizers.path(TOKENIZER)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                leaves = [own.leaves(x.as_py() or "") for x in column(rows, "text")]
                yield pa.RecordBatch.from_arrays(
                    [*(column(rows, n) for n in ("doc_id", "text", "edits")), pa.array([x[0] for x in leaves], pa.list_(pa.int32())),
                     pa.array([x[1] for x in leaves], pa.list_(pa.int32()))], names=["doc_id", "text", "edits", "chars", "tokens"])

    edits = "array<struct<at:int,drop:int,put:string>>"
    # A column of that name that holds no edits is another one.
    own = dict(documents.dtypes).get("edits", "")
    named = documents if own.startswith("array<struct<at:") else documents.withColumn("edits", F.lit(None).cast(edits))
    return (named.select(F.col("doc_id").cast("long"), "text", F.col("edits").cast(edits).alias("edits"))
            .mapInArrow(build, f"doc_id long, text string, edits {edits}, chars array<int>, tokens array<int>"))


def apply_edits(counted: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts of counted documents before and after their `edits`, made in order, each on the text the last one left.

    Returns doc_id, tokens_before, tokens_after, pre_tokens (after), encoded (pre-tokens encoded anew), text. A NULL text is
    empty, and stays NULL if nothing is put into it; NULL or empty edits change nothing; places outside the text are moved to its
    ends; a NULL `put` deletes. Repeated rows give repeated rows.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, edits, chars, tokens in zip(*(column(batch, n) for n in ("text", "edits", "chars", "tokens"))):
                before, new = text.as_py(), text.as_py() or ""
                tree = Tree(chars.as_py() or [], tokens.as_py() or [])
                first = tree.tokens
                for edit in edits.as_py() or []:
                    if edit is not None:
                        new = tree.edit(new, edit["at"] or 0, edit["drop"] or 0, edit["put"] or "", own)
                for values, value in zip(out, (first, tree.tokens, sum(len(c) for c, _ in tree.leaves), tree.encoded, None if before is None and not new else new)):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id")] + [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "tokens_before", "tokens_after", "pre_tokens", "encoded", "text"])

    return counted.mapInArrow(change, "doc_id long, tokens_before long, tokens_after long, pre_tokens long, encoded long, text string")


def with_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """`documents` with their edits from a table (doc_id, turn, at, drop, put), in the order of turn."""
    listed = edits.groupBy(F.col("doc_id").alias("__edited_doc")).agg(F.sort_array(F.collect_list(F.struct("turn", "at", "drop", "put"))).alias("__edits"))
    return (documents.join(listed, F.col("doc_id") == F.col("__edited_doc"), "left")
            .withColumn("edits", F.transform("__edits", lambda x: F.struct(x["at"].alias("at"), x["drop"].alias("drop"), x["put"].alias("put")))).drop("__edits", "__edited_doc"))


def op8_edit_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, counted and then edited in three places: a word put in, seven characters taken out, two replaced."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    moves = zip(PLACES, (0, 7, 2), (" revised", "", "'s 20"))
    edits = F.array(*[F.struct(F.floor(size * p / 8).cast("int").alias("at"), F.lit(d).alias("drop"), F.lit(x).alias("put")) for p, d, x in moves])
    return apply_edits(count_tokens(documents.withColumn("edits", edits))).select("doc_id", "tokens_before", "tokens_after", "pre_tokens", "encoded")
