"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document is its token ids and one end id. It is cut into pieces whose lengths belong to reciprocal-capacity classes:
class k holds lengths of which k fill a sequence and leave at most ``WASTE`` ids of padding. Among all such cuts the one
with the fewest pieces is taken; what is longer than a sequence gives whole sequences first.

Every sequence of class k holds exactly k pieces, so a worker fills its sequences from the stream of its own documents,
looking at no other worker: fewer than k pieces of a class wait at any time. What waits at the end of a task (at most a
sequence of each class) is numbered over all tasks from (class, task) counts and fills sequences in the same way. What is
left then, less than one sequence of each class over the whole table, is cut into powers of two, laid end to end from the
longest to the shortest and cut at multiples of the capacity. The last sequence ends in powers of two, which need no
padding. So padding is at most ``WASTE`` ids of a sequence, whatever the table's size.

The capacity is a power of two. The tokenizer is given as the text of its JSON file and broadcast (a few MB, at most
``TOKENIZER_BYTES``). Ids are written once as little-endian unsigned 32-bit numbers; later steps cut those bytes.

Null and empty texts are the end id alone. Keys may be null or repeat: every row is a document of its own and repeats get
pieces of their own. Very long texts are encoded whole. Other columns are not looked at, so their names cannot clash. An
empty table gives no pieces. Marks of special tokens within a text are ordinary text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from almenara.session import scratch

CAPACITY = 1024
WASTE = 8
END_ID = 0
TOKENIZER_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Runs without a space from this length on are left to ``tokenizers``, whose time grows gently with the run.
LONG_RUN = 1000

#: Fixed value: how a byte-level tokenizer cuts a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Numbers of sequences: by task, then by pooled class, then the last ones.
_TASK_BITS, _POOLED, _LAST = 36, 1 << 61, 1 << 62


def byte_names() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks(json_text: str) -> dict[bytes, int] | None:
    """A vocabulary as ranks of byte strings, if ids are those ranks and nothing else shapes them; else None."""
    spec = json.loads(json_text)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    names = byte_names()
    special = {token["content"] for token in spec["added_tokens"]}
    merged = ["".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
    if any(model["vocab"].get(token) != 256 + i for i, token in enumerate(merged)):
        return None
    return {bytes(names[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def settled() -> set[str]:
    """Characters whose kind has been the same since an early version of Unicode, plain white space included."""
    old = unicodedata.ucd_3_2_0
    kinds = ((c, old.category(c)) for c in map(chr, range(0x10000)))
    return {c for c, kind in kinds if kind[0] in "LNPS" and kind == unicodedata.category(c)} | set(" \n\t\r")


class Encoder:
    """Texts to bytes of ids as the tokenizer gives them.

    Texts of characters that any two libraries class alike, without very long words, go through the same vocabulary in
    ``tiktoken``, which is four times as fast and gives the same ids (tested); all others go through ``tokenizers``.
    """

    def __init__(self, json_text: str) -> None:
        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.encode_special_tokens = True
        known = ranks(json_text)
        self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=known, special_tokens={}) if known else None
        self.settled = settled()
        self.long = re.compile(r"[^ ]{%d}" % LONG_RUN)

    def __call__(self, text: str) -> bytes:
        if self.fast and self.settled.issuperset(text) and not self.long.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def cuts(capacity: int = CAPACITY, waste: int = WASTE) -> list[list[int]]:
    """For each length below the capacity the fewest class lengths that make it up, longest first."""
    sizes = [s for s in range(capacity, 0, -1) if capacity % s <= waste]
    best: list[list[int]] = [[]]
    for length in range(1, capacity):
        size = min((s for s in sizes if s <= length), key=lambda s: len(best[length - s]))
        best.append(sorted([size, *best[length - size]], reverse=True))
    return best


def filled(batches: Iterable[pa.RecordBatch], encode: Encoder, capacity: int, waste: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a task's documents: sequences as they fill, then the pieces that wait, without a sequence."""
    table = cuts(capacity, waste)
    task, made = TaskContext.get().partitionId(), 0
    end = np.asarray([end_id], "<u4").tobytes()
    waiting: dict[int, list[tuple]] = {}
    rows: list[tuple] = []
    key_type, size = None, 0

    def flush() -> pa.RecordBatch:
        names = ("key", "start", "ids", "doc_tokens", "class", "sequence_id", "offset", "task", "at")
        kinds = (key_type, pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=list(names))

    for batch in batches:
        key_type = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = encode(text or "") + end
            total = len(data) // 4
            whole, rest = divmod(total, capacity)
            start = 0
            for length in [capacity] * whole + table[rest]:
                k = capacity // length
                held = waiting.setdefault(k, [])
                held.append((key, start, data[4 * start : 4 * (start + length)], total))
                start += length
                if len(held) == k:
                    offset = 0
                    for piece in held:
                        rows.append((*piece, k, (task << _TASK_BITS) + made, offset, task, 0))
                        offset += len(piece[2]) // 4
                    size += 4 * offset
                    made += 1
                    held.clear()
                    if size > BATCH_BYTES:
                        yield flush()
                        rows, size = [], 0
    for k, held in waiting.items():
        rows += [(*piece, k, None, None, task, at) for at, piece in enumerate(held)]
    if rows:
        yield flush()


def _length(ids: str = "ids") -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("long")


def pooled(left: DataFrame, capacity: int) -> DataFrame:
    """Pieces that waited at the end of a task, numbered within their class; ``whole`` if their sequence is full."""
    counts = left.groupBy("class", "task").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("class").orderBy("task")  # a row per task
    base = counts.select(
        F.col("class").alias("_class"), F.col("task").alias("_task"), (F.sum("m").over(upto) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy("class")).alias("all")
    )
    numbered = left.join(base, (F.col("class") == F.col("_class")) & (F.col("task") == F.col("_task"))).withColumn("number", F.col("base") + F.col("at"))
    bin_ = F.floor(F.col("number") / F.col("class"))
    return numbered.withColumn("bin", bin_).withColumn("whole", F.col("bin") < F.floor(F.col("all") / F.col("class")))


def last(rest: DataFrame, capacity: int) -> DataFrame:
    """Less than a sequence of each class, cut into powers of two and laid end to end."""
    bits = capacity.bit_length() - 1
    bit = F.explode(F.filter(F.sequence(F.lit(bits), F.lit(0)), lambda b: F.getbit(_length(), b) == 1))
    cut = rest.withColumn("bit", bit).withColumn("length", F.expr("shiftleft(1L, bit)"))
    skip = (_length() - F.pmod(_length(), F.col("length") * 2)).cast("int")
    cut = cut.select("key", (F.col("start") + skip).alias("start"), F.substring("ids", 4 * skip + 1, (4 * F.col("length")).cast("int")).alias("ids"), "doc_tokens", "length", "class", "number")
    # Bounded by one sequence of each class, so one window holds all of it.
    line = Window.orderBy(F.col("length").desc(), "class", "number", "start")
    at = F.sum("length").over(line) - F.col("length")
    laid = cut.withColumn("place", at).withColumn("all", F.sum("length").over(Window.partitionBy()))
    whole = F.floor(F.col("place") / capacity)
    tail, inside = F.pmod("all", F.lit(capacity)), F.pmod("place", F.lit(capacity))
    # The tail's sequences are the powers of two that add up to it, longest first.
    begin = F.array_max(F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.when(F.getbit(tail, b) == 1, tail - F.pmod(tail, F.call_function("shiftleft", F.lit(2).cast("long"), b)))), lambda x: x <= inside))
    short = whole == F.floor(F.col("all") / capacity)
    return laid.select(
        "key", "start", "ids", "doc_tokens",
        (F.lit(_LAST) + whole * 2 * capacity + F.when(short, begin).otherwise(0)).alias("sequence_id"), F.when(short, inside - begin).otherwise(inside).alias("offset"),
    )


def pack(documents: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, waste: int = WASTE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: key, start, length, ids (bytes), doc_tokens, sequence_id and offset there.

    Documents are encoded once; the pieces are written to the shared folder and read again.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    if len(tokenizer_json) > TOKENIZER_BYTES:
        raise ValueError(f"a tokenizer of more than {TOKENIZER_BYTES} bytes is not broadcast")
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return filled(batches, Encoder(shared.value), capacity, waste, end_id)

    folder = scratch(spark, "packing")
    rows.mapInArrow(run, f"key {kind}, start long, ids binary, doc_tokens long, class int, sequence_id long, offset long, task int, at int").write.parquet(folder)
    pieces = spark.read.parquet(folder)
    columns = ("key", "start", "ids", "doc_tokens", "sequence_id", "offset")
    left = pooled(pieces.filter("sequence_id is null").drop("sequence_id", "offset"), capacity)
    before = Window.partitionBy("class", "bin").orderBy("number")  # at most ``capacity`` rows
    full = left.filter("whole").withColumn("sequence_id", F.lit(_POOLED) + F.col("bin") * 2 * capacity + F.col("class")).withColumn("offset", F.sum(_length()).over(before) - _length())
    out = pieces.filter("sequence_id is not null").select(*columns).unionByName(full.select(*columns)).unionByName(last(left.filter("not whole"), capacity).select(*columns))
    return out.select(F.col("key").alias(key), "start", _length().alias("length"), "ids", "doc_tokens", "sequence_id", "offset")
