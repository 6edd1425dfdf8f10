"""Line dedup: repeated lines leave all documents but one; the answer is a bitmap per document, not text.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least ``MIN_POINTS`` code
points that stand in at least ``MIN_DOCUMENTS`` documents are dropped everywhere but in the largest id holding them
(there all its lines stay).

Lines become (128-bit hash, id, position) and are range-partitioned by hash with the id, descending, and position as
secondary sort, so the first id of a hash is the one that keeps it and a stream needs to look no further than the
third id to know whether the others go. A line in a third of all documents covers many partitions, as ids take part
in the ranges; each partition reports how its first and last hash begin and end (a few numbers per partition, all
that reaches the driver), and a second stream over the same sorted partitions decides. Sorted partitions are
checkpointed once, so both streams and any repeated task see the same rows.

The bitmap is compressed: 64 lines a word, only words that drop a line, as (word number, bits to drop).

Null text is one empty line. Rows that share id and text are one document with one bitmap; rows that share the id
alone count as one document of which each text has its own bitmap. A null id is smaller than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.llm.columns import WHITE, ascii_lower
from almenara.session import pin

MIN_POINTS = 20
MIN_DOCUMENTS = 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line that may be dropped: hash in two halves, id, print of the text, position."""
    lines = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.posexplode(split_lines(F.col(text))).alias("at", "line"))
    lines = lines.filter(F.length("line") >= MIN_POINTS).withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= MIN_POINTS)
    return lines.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7919), "line").alias("b"), "id", "print", "at")


#: What a partition reports of its first and its last hash: the hash, its first and last id here, and how many.
BORDER = tuple(f"{end}_{c}" for end in ("head", "tail") for c in ("a", "b", "first", "last", "ids"))


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the hash and the id of a batch; a null id is the smallest number."""
    lowest = np.iinfo(np.int64).min
    return (*(np.asarray(batch.column(k)) for k in (0, 1)), np.asarray(batch.column(2).fill_null(lowest)))


def changes(a: np.ndarray, b: np.ndarray, doc: np.ndarray, hash_now: tuple[int, int] | None, doc_now: int) -> tuple[np.ndarray, np.ndarray]:
    """Where another hash begins and where another id of a hash begins, given what stood before the batch."""
    new_hash = np.ones(len(a), bool)
    new_hash[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new_hash[0] = hash_now != (int(a[0]), int(b[0]))
    new_doc = new_hash.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    new_doc[0] |= int(doc[0]) != doc_now
    return new_hash, new_doc


def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition with rows: its number and ``BORDER``."""
    head = now = None
    for batch in batches:
        a, b, doc = columns(batch)
        if not len(a):
            continue
        new_hash, new_doc = changes(a, b, doc, now and now[:2], now[3] if now else 0)
        turns = [*np.flatnonzero(new_hash).tolist(), len(a)]
        if now and turns[0]:
            now = (*now[:3], int(doc[turns[0] - 1]), now[4] + int(new_doc[: turns[0]].sum()))
        if len(turns) > 1:
            if now:
                head = head or now
            groups = [(int(a[t]), int(b[t]), int(doc[t]), int(doc[u - 1]), int(new_doc[t:u].sum())) for t, u in {(turns[0], turns[1]), (turns[-2], turns[-1])}]
            groups.sort(key=lambda g: g[:2] != (int(a[turns[0]]), int(b[turns[0]])))
            if len(groups) > 1:
                head = head or groups[0]
            now = groups[-1]
    if now:
        row = [TaskContext.get().partitionId(), *(head or now), *now]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["part", *BORDER])


def carried(rows: list[tuple[int, ...]]) -> dict[int, tuple]:
    """For each partition: of its first hash, the ids before it and the last of them; the totals of both end hashes."""
    chains: list[list[tuple[int, int, tuple[int, ...]]]] = []
    for part, *ends in rows:
        head, tail = tuple(ends[:5]), tuple(ends[5:])
        for side, end in ((0, head), *([(1, tail)] if tail[:2] != head[:2] else [])):
            if side == 0 and chains and chains[-1][-1][2][:2] == end[:2]:
                chains[-1].append((part, side, end))
            else:
                chains.append([(part, side, end)])
    known: dict[int, dict[int, tuple]] = {}
    for chain in chains:
        seen, last, places = 0, 0, []
        for part, side, (_, _, first, final, ids) in chain:
            places.append((part, side, seen, last))
            seen += ids - (seen > 0 and first == last)
            last = final
        for part, side, before, previous in places:
            known.setdefault(part, {})[side] = (chain[0][2][:2], before, previous, seen)
    return {part: (sides[0], sides.get(1, sides[0])) for part, sides in known.items()}


def decide(batches: Iterable[pa.RecordBatch], carry: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Stream sorted lines and let through those to drop (id, print, position)."""
    ends = carry.get(TaskContext.get().partitionId())
    if ends is None:
        return
    first_hash, seen, doc_now, _ = ends[0]
    hash_now = first_hash if seen else None
    waiting: list[pa.RecordBatch] = []  # lines of a hash's second id, until a third is seen
    for batch in batches:
        a, b, doc = columns(batch)
        if not len(a):
            continue
        new_hash, new_doc = changes(a, b, doc, hash_now, doc_now)
        group, count = np.cumsum(new_hash), np.cumsum(new_doc)
        base = np.zeros(group[-1] + 1, np.int64)
        base[0] = -seen
        base[group[new_hash]] = count[new_hash] - 1
        rank = count - base[group]  # 1 for the largest id of a hash
        top = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(top, group, rank)
        total = top[group]
        for known, _, _, ids in ends:
            total[(a == known[0]) & (b == known[1])] = ids
        if waiting and new_hash[0]:
            waiting = []
        elif waiting and top[0] >= MIN_DOCUMENTS:
            yield from waiting
            waiting = []
        elif waiting and group[-1] > 0:
            waiting = []
        slim = batch.select(["id", "print", "at"])
        drop = (rank >= 2) & (total >= MIN_DOCUMENTS)
        if drop.any():
            yield slim.filter(pa.array(drop))
        hash_now, seen, doc_now = (int(a[-1]), int(b[-1])), int(rank[-1]), int(doc[-1])
        open_end = (group == group[-1]) & (rank == 2) & ~drop
        if open_end.any() and hash_now not in (ends[0][0], ends[1][0]):
            waiting.append(slim.filter(pa.array(open_end)))


def drop_words(documents: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Compressed bitmaps of the documents that lose lines: (id, print, n_dropped, words)."""
    spark = documents.sparkSession
    rows = pin(line_rows(documents, key, text))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col("a"), F.col("b"), F.col("id").desc_nulls_last()]
    dealt = pin(rows.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered, "at"))
    # One row per partition.
    ends = dealt.mapInArrow(borders, ", ".join(f"{c} long" for c in ("part", *BORDER))).collect()
    carry = spark.sparkContext.broadcast(carried(sorted(map(tuple, ends))))
    dropped = dealt.mapInArrow(lambda batches: decide(batches, carry.value), "id long, print long, at int")
    words = dropped.groupBy("id", "print", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
    return words.groupBy("id", "print").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``n_lines``, ``n_dropped`` and ``kept``: the text without its dropped lines (null stays null)."""
    documents = documents.drop("n_lines", "n_dropped", "kept")
    words = drop_words(documents, key, text).withColumnsRenamed({"id": "_id", "print": "_print", "n_dropped": "_n", "words": "_words"})
    clean = F.coalesce(F.col(text), F.lit(""))
    joined = documents.join(words, F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(clean) == F.col("_print")), "left")
    stays = F.filter(split_lines(F.col(text)), lambda line, i: F.coalesce(F.try_element_at("_words", F.shiftright(i, 6)), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0)
    n_lines = (F.length(clean) - F.length(F.translate(clean, "\n", "")) + 1).cast("long")
    return joined.select(
        *documents.columns, n_lines.alias("n_lines"), F.coalesce("_n", F.lit(0)).alias("n_dropped"),
        F.when(F.col("_n").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")).alias("kept"),
    )
