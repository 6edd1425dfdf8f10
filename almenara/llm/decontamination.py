"""Benchmark decontamination with DataFrame functions only.

Words are maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is 13
consecutive words of a benchmark item; an item of fewer words is one window. A document word inside any occurrence
of a window is hit.

Scanning every window of every document would hash each word 13 times. A window of n words that occurs in a document
covers at least one aligned block of q = (n + 1) // 2 words there (blocks start at multiples of q). So every document
is cut into such blocks once, and their hashes meet the hashes of all q-word runs of the items. Only documents with a
common block are then scanned window by window, and each window is verified word for word. Both steps lose nothing.

Items fall into four classes by length (13 and more, 7 to 12, 3 to 6, 1 to 2 words) with q = 7, 4, 2 and 1; a class
without items costs nothing. The items' hashes are broadcast only when there are at most ``BROADCAST_WINDOWS`` of
them (about 16 bytes each); otherwise Spark joins by shuffle with the same result.

Null and empty texts have no words and are never hit; items without words have no window. Equal items and repeated
rows count as often as they stand. Ids may repeat: documents are told apart by id and text. Null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.llm.columns import ascii_lower, count_between, small
from almenara.session import pin

WINDOW = 13
BROADCAST_WINDOWS = 500_000
BROADCAST_KEYS = 200_000
#: Fewest and most words of an item of each class, and the length of the blocks that find it.
CLASSES = ((13, None, 7), (7, 12, 4), (3, 6, 2), (1, 2, 1))
#: What separates words once A-Z are lower-cased, and before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text, in order."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """``size(words(text))`` without lower-casing: splitting is many times cheaper than matching a negated class."""
    return count_between(text, RAW_SEPARATORS)


def blocks(w: Column, length: int) -> Column:
    """Hashes of the aligned blocks of ``length`` words."""
    n = F.floor(F.size(w) / length).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(w, i * length + 1, length))))


def every_run(w: Column, length: int | Column) -> Column:
    """All runs of ``length`` consecutive words, as structs of their first place and the words."""
    last = F.size(w) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.slice(w, i + 1, length).alias("run"))))


def hits(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per hit document and text: the key, ``digest`` of the text, hit word places as ranges, and items.

    ``words`` is the number of words of the text, ``spans`` holds (first word, last word + 1) of each occurrence, sorted; ``items`` the distinct items, sorted as text.
    """
    docs = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bench = benchmark.select(F.col(item).cast("string").alias("_item"), words(F.col(item_text)).alias("_words")).withColumn("_n", F.size("_words")).filter("_n > 0")
    sizes = bench.agg(
        *[F.coalesce(F.sum(F.when((F.col("_n") >= lo) & ((F.col("_n") <= hi) if hi else F.lit(True)), F.greatest(F.col("_n") - q + 1, F.lit(1)))), F.lit(0)).alias(f"c{q}") for lo, hi, q in CLASSES]
    ).first()
    used = [(lo, hi, q) for lo, hi, q in CLASSES if sizes[f"c{q}"]]
    total = sum(sizes)
    if not used:
        return docs.limit(0).select("_key", F.md5("_text").alias("digest"), F.lit(0).alias("words"), F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("end"))).alias("spans"), F.array(F.lit("")).alias("items"))

    # 1. Which documents share an aligned block with an item: only hashes move.
    cut = docs.select("_key", F.xxhash64("_text").alias("_print"), words(F.col("_text")).alias("_words"))
    found = cut.select("_key", "_print", F.explode(F.concat(*[F.coalesce(blocks(F.col("_words"), q), F.array().cast("array<bigint>")) for _, _, q in used])).alias("_block"))
    known = bench.select(F.explode(F.concat(*[
        F.when((F.col("_n") >= lo) & ((F.col("_n") <= hi) if hi else F.lit(True)), F.transform(every_run(F.col("_words"), q), lambda r: F.xxhash64(r["run"]))).otherwise(F.array().cast("array<bigint>"))
        for lo, hi, q in used
    ])).alias("_block")).distinct()
    candidates = found.join(small(known, total, BROADCAST_WINDOWS), "_block", "left_semi").select("_key", "_print").distinct().withColumnRenamed("_key", "_cand").withColumnRenamed("_print", "_cprint")
    candidates = pin(candidates)

    # 2. Every window of those documents, verified word for word.
    # Few documents are candidates: their keys are counted and go to the texts, which move only beyond the bound.
    few = small(candidates, candidates.count(), BROADCAST_KEYS)
    whole = docs.withColumn("_print", F.xxhash64("_text")).join(few, F.col("_print").eqNullSafe(F.col("_cprint")) & F.col("_key").eqNullSafe(F.col("_cand")), "left_semi")
    whole = whole.select("_key", "_text").distinct().select("_key", F.md5("_text").alias("digest"), words(F.col("_text")).alias("_words"))
    windows = bench.select("_item", F.explode(F.transform(every_run(F.col("_words"), F.least(F.col("_n"), F.lit(WINDOW))), lambda r: r["run"])).alias("_run")).distinct()
    windows = windows.groupBy("_run").agg(F.sort_array(F.collect_set("_item")).alias("_items")).withColumn("_hash", F.xxhash64("_run")).withColumn("_len", F.size("_run"))
    lengths = [r["_len"] for r in bench.select(F.least(F.col("_n"), F.lit(WINDOW)).alias("_len")).distinct().collect()]  # at most 13 values
    scanned = whole.select("_key", "digest", F.size("_words").alias("_size"), F.explode(F.concat(*[F.coalesce(every_run(F.col("_words"), n), F.array().cast("array<struct<at:int,run:array<string>>>")) for n in sorted(lengths)])).alias("_w"))
    scanned = scanned.select("_key", "digest", "_size", F.col("_w.at").alias("_at"), F.col("_w.run").alias("_drun"), F.xxhash64("_w.run").alias("_hash"))
    verified = scanned.join(small(windows, total, BROADCAST_WINDOWS), "_hash").filter(F.col("_drun") == F.col("_run"))
    return verified.groupBy("_key", "digest").agg(
        F.max("_size").alias("words"),
        F.sort_array(F.collect_set(F.struct(F.col("_at").alias("first"), (F.col("_at") + F.col("_len")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """How many word places lie in at least one of the sorted spans."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(F.greatest(a["reach"], s["end"]).alias("reach"), (a["n"] + F.greatest(s["end"] - F.greatest(a["reach"], s["first"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )


def judge(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit``, ``n_items``, ``items``, ``spans`` and ``contaminated`` appended.

    Columns of these names are replaced. A document is contaminated if at least a twentieth of its words is hit.
    """
    own = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    left = documents.drop(*own)
    found = hits(left, benchmark, key, text).drop("words").withColumnsRenamed({"_key": "_hit_key", "digest": "_hit_digest"})
    n = word_count(F.col(text))
    # The digest is a column of its own, so the join moves no text that nobody asks for.
    known = left.withColumn("n_words", n).withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    joined = known.join(found, F.col(key).eqNullSafe(F.col("_hit_key")) & (F.col("_digest") == F.col("_hit_digest")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0))
    return joined.select(
        *left.columns, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the contaminated ones; only keys and digests of these are joined."""
    found = hits(documents, benchmark, key, text).withColumn("_n", covered(F.col("spans"))).filter("_n > 0 AND 20 * _n >= words")
    found = pin(found.select(F.col("_key").alias("_hit_key"), F.col("digest").alias("_hit_digest")))
    gone = small(found, found.count(), BROADCAST_KEYS)
    same = F.col(key).eqNullSafe(F.col("_hit_key")) & (F.md5(F.coalesce(F.col(text), F.lit(""))) == F.col("_hit_digest"))
    return documents.join(gone, same, "left_anti")
