"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Built from DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import read
from tablewright.sources.staging import stage

WORDS = 5
THRESHOLD = 0.8
#: Values of an item's sketch: its smallest shingle hashes. Small items are sketched whole.
SKETCH = 16
#: A document is compared exactly with an item if it holds this share of the item's sketch. That a document
#: with 0.8 of an item's shingles holds less of a 16-value sketch happens about once in 3,000 times.
CANDIDATE = 0.45
#: Sketch values that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_VALUES = 500_000
#: Item sizes, in shingles, from which a partition of its own begins.
PARTITIONS = (1, 17, 65, 257, 1025)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(df: DataFrame, keys: list[str], width: int = WORDS) -> DataFrame:
    """A row (keys, hash) per run of `width` words of `df`'s column `text`."""
    split = df.select(*keys, words(F.col("text")).alias("words"))
    at = split.select(*keys, "words", F.explode(F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))).alias("at"))
    return at.select(*keys, F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(width)]).alias("hash"))


def grams(df: DataFrame, key: str, width: int) -> DataFrame:
    """A row (key, gram) per run of `width` words, as text."""
    split = df.select(key, words(F.col("text")).alias("words"))
    at = split.select(key, "words", F.explode(F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))).alias("at"))
    return at.select(key, F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(width)]).alias("gram"))


def sketches(items: DataFrame, width: int = WORDS, sketch: int = SKETCH) -> DataFrame:
    """item_id, size, partition, need, hash: the smallest hashes of each item's shingle set.

    `partition` numbers the size class; within one, sketches have one size and `need` is the
    number of matches that makes a candidate.
    """
    sets = (shingles(items, ["item_id"], width).groupBy("item_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes")))
    size = F.size("hashes")
    part = sum(((size >= F.lit(x)).cast("int") for x in PARTITIONS), F.lit(0))
    kept = F.least(size, F.lit(sketch))
    return sets.select("item_id", size.alias("size"), part.alias("partition"), F.ceil(kept * F.lit(CANDIDATE)).cast("int").alias("need"),
                       F.explode(F.slice("hashes", F.lit(1), kept)).alias("hash"))


def contaminated(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS,
                 sketch: int = SKETCH) -> DataFrame:
    """Pairs (doc_id, item_id, shared, size, containment) where a document holds `threshold` of an item's word shingles.

    Texts are compared in lower case, by runs of letters and digits. Items with fewer than `width`
    words hold no shingle and match nothing, as do NULL or empty texts; rows with a NULL id are
    left out. Repeated item ids are one item with the shingles of all its rows, repeated document ids
    one document. Documents are read twice: every shingle of every document against the sketches,
    then the candidates' whole shingle sets.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    tests = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    signed = stage(sketches(tests, width, sketch), "decontaminate-sketch")
    sought = F.broadcast(signed) if signed.count() <= BROADCAST_VALUES else signed
    candidates = stage(
        shingles(docs, ["doc_id"], width).join(sought, "hash").groupBy("doc_id", "item_id")
        .agg(F.collect_set("hash").alias("matched"), F.first("need").alias("need"))
        .where(F.size("matched") >= F.col("need")).select("doc_id", "item_id"), "decontaminate-candidates")
    # The sets meet as text, so that equal hashes of different runs of words cannot count.
    wanted = tests.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    sets = grams(wanted, "item_id", width).groupBy("item_id").agg(F.collect_set("gram").alias("grams"))
    runs = stage(candidates.join(sets, "item_id").select("doc_id", "item_id", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "decontaminate-runs")
    held = grams(docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", width)
    pairs = held.join(runs, ["doc_id", "gram"]).select("doc_id", "item_id", "gram", "size")
    return (pairs.groupBy("doc_id", "item_id", "size").agg(F.countDistinct("gram").alias("shared"))
            .withColumn("containment", F.col("shared") / F.col("size")).where(F.col("shared") >= F.lit(threshold) * F.col("size"))
            .select("doc_id", "item_id", "shared", F.col("size").cast("long").alias("size"), "containment"))


def decontaminate(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """`documents` without those that hold a test item; rows with a NULL id or text, and columns of any other name, stay."""
    dirty = stage(contaminated(documents, items, **how).select("doc_id").distinct(), "decontaminate-dirty")
    return documents.join(dirty.withColumnRenamed("doc_id", "__dirty_doc"), F.col("doc_id") == F.col("__dirty_doc"), "left_anti")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


OP3_SQL = r"""
with words as (
  select doc_id as id, 'd' as kind, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w
  from documents where doc_id is not null and text is not null
  union all
  select item_id, 'i', regexp_extract_all(lower(text), '[\p{L}\p{N}]+')
  from benchmark where item_id is not null and text is not null),
grams as (
  select distinct id, kind, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as gram
  from (select id, kind, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
sizes as (select id as item_id, count(*) as size from grams where kind = 'i' group by 1)
select d.id as doc_id, i.id as item_id, count(*) as shared, any_value(s.size) as size, count(*) / any_value(s.size) as containment
from grams d join grams i on d.kind = 'd' and i.kind = 'i' and d.gram = i.gram join sizes s on s.item_id = i.id
group by 1, 2 having count(*) >= 0.8 * any_value(s.size)
"""
