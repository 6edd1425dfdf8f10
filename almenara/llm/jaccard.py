"""N-gram Jaccard join by chosen paths.

A text's set holds its runs of five consecutive words (letters, digits and characters beyond ASCII; ASCII and Latin-1
letters in lower case); a text of one to four words has one run. Texts with equal sets are one class. Classes are
linked when the Jaccard similarity of their sets is at least 0.8, judged on whole sets.

Finding candidates. Each class has 64 tokens, the minima of its set under 64 hashes. A run deals classes to nodes: at
each level a class draws about ``BRANCHES`` of its tokens by a hash of path and token, so two classes that share a
token and a path draw it together. Nodes of at most ``LIMIT`` classes are compared pair by pair in one task; larger
ones are split by further tokens. A large node in which classes agree in ``ALIKE`` of their tokens on average would
not get smaller that way for long: it becomes one candidate group as a whole. Every level loses some similar pairs, so runs are
repeated until ``RECALL`` of the pairs at the threshold are expected to survive ``DEPTH`` levels; copies of one text
find each other by many ways.

Verifying. Candidates that hang together are compared set by set, all with all: groups of more than ``BLOCK`` classes
in pairs of blocks, each pair of blocks a task. Nothing is cut: every link inside a candidate group is found, counted
with the copies of the texts, and never written as a pair. So the work for m different but similar texts is
m * m / (2 * BLOCK**2) block pairs, which is what exact counts of their links need.

Results are one row per document: ``class_id``, the smallest id that links lead to (its own if none), and ``n_links``,
the number of other documents within the threshold, copies included. Null and empty texts, and texts without words,
have no links. A null id is never the smallest. Rows that repeat are copies of each other. Ids are assumed to name one text;
rows that share an id with different texts are judged by their texts.

Classes are told apart by two 64-bit sums over their sets; while linking, by the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.llm.arrays import WORD, Hasher, combined, lowered, mix, pieces, runs
from almenara.llm.columns import small
from almenara.llm.graph import components, groups, smallest_reached
from almenara.session import pin

WORDS = 5
TOKENS = 64
BRANCHES = 2.0
LIMIT = 1024
BLOCK = 400
RECALL = 0.999
DEPTH = 3
MAX_LEVELS = 20
ALIKE = 0.4
BROADCAST_MEMBERS = 200_000
#: Tokens in which two classes must agree to be verified: at similarity 0.8 one pair in two thousand has fewer.
AGREE = 39


def run_count(recall: float = RECALL, depth: int = DEPTH, similarity: float = 0.8) -> int:
    """Runs until pairs at the threshold are found with the wanted chance, if nodes are ``depth`` levels deep."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-BRANCHES * similarity * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a piece, sorted, and where each text's begin (and their end)."""
    low, _ = lowered(data)
    starts, ends, doc = runs(WORD[low], at)
    n = len(at) - 1
    cut = np.searchsorted(doc, np.arange(n + 1))
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = Hasher(low, seed=5)(starts, ends)
    first = np.flatnonzero(doc[: 1 - WORDS] == doc[WORDS - 1 :]) if len(doc) >= WORDS else np.zeros(0, np.int64)
    value = word[first]
    for k in range(1, WORDS):
        value = combined(value, word[first + k])
    owner = doc[first]
    short = np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < WORDS))
    if len(short):
        one = []
        for k in short.tolist():
            x = word[cut[k] : cut[k] + 1]
            for j in range(cut[k] + 1, cut[k + 1]):
                x = combined(x, word[j : j + 1])
            one.append(x)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, *one])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    cut = np.searchsorted(owner, np.arange(n + 1))
    for k in range(n):
        value[cut[k] : cut[k + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(n + 1))


def names(value: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both names and the size of each set; the names of an empty set are 0."""
    size = np.diff(cut)
    own = np.flatnonzero(size)
    a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(own):
        count = size[own].astype(np.uint64)
        a[own] = mix(np.add.reduceat(mix(value), cut[own]) + count)
        b[own] = mix(np.add.reduceat(mix(value ^ np.uint64(0x1B873593CC9E2D51)), cut[own]) + count)
    return a, b, size


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both names of each text's set, the size of the set and its tokens (rows of texts without words are zero)."""
    n = len(texts)
    a, b, size, tokens = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, TOKENS), np.uint32)
    numbers = mix(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for lo, hi, data, at in pieces(texts):
        value, cut = shingles(data, at)
        a[lo:hi], b[lo:hi], size[lo:hi] = names(value, cut)
        own = np.flatnonzero(np.diff(cut))
        begin = cut[own]
        for k in range(TOKENS if len(own) else 0):
            tokens[lo + own, k] = np.minimum.reduceat(((value * (numbers[2 * k] | np.uint64(1)) + numbers[2 * k + 1]) >> np.uint64(32)).astype(np.uint32), begin)
    return a, b, size, tokens


def sketches(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b, size, tokens) for each document; the tokens as bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size, tokens = sketch(batch.column(1))
            packed = pa.array([t.tobytes() for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(size), packed], names=["id", "a", "b", "size", "tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, a long, b long, size long, tokens binary")


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint32).reshape(len(column), -1)


def children(path: np.ndarray, tokens: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that go on and the nodes they go to: about ``BRANCHES`` for each row."""
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    salt = mix(np.array([seed], np.uint64) * np.uint64(0xD1B54A32D192ED03))[0]
    node = mix((tokens.astype(np.uint64) | place) + mix(path.astype(np.uint64) ^ salt)[:, None])
    drawn = mix(node ^ np.uint64(0x94D049BB133111EB)) < np.uint64(int(BRANCHES / TOKENS * 2**64))
    row, at = np.nonzero(drawn)
    return row, node[row, at]


def deal(rows: DataFrame, level: int, repeats: int, steps: int, carry: bool) -> DataFrame:
    """(node, a) of the next level from (node, a, tokens), with the tokens if they are to be carried on.

    Each repeat is a run of its own; in each, ``steps`` tokens are drawn one after the other. A node's name comes from
    its path, so no row is made twice.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                tokens = unpacked(part.column(2))
                for k in range(repeats):
                    row, node = np.arange(len(part)), np.asarray(part.column(0)).view(np.uint64)
                    for step in range(steps):
                        child, node = children(node, tokens[row], (level * 1000 + k) * 10 + step)
                        row = row[child]
                    columns = [pa.array(node.view(np.int64)), part.column(1).take(pa.array(row))]
                    yield pa.RecordBatch.from_arrays([*columns, part.column(2).take(pa.array(row))] if carry else columns, names=["node", "a", "tokens"][: 2 + carry])

    return rows.select("node", "a", "tokens").mapInArrow(run, "node long, a long" + ", tokens binary" * carry)


def likeness(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pairs, agreements, smallest a): neighbours of one node in a task's rows, compared in all tokens."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    node = table.column(0).to_numpy()
    order = np.argsort(node, kind="stable")
    node, name = node[order], table.column(1).to_numpy()[order]
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    agree = np.zeros(len(node), np.int64)
    for lo in range(0, len(node) - 1, 4096):
        part = unpacked(table.column(2).take(pa.array(order[lo : lo + 4097])))
        agree[lo + 1 : lo + len(part)] = (part[1:] == part[:-1]).sum(axis=1)
    agree[begin] = 0
    size = np.diff(np.append(begin, len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[begin], size - 1, np.add.reduceat(agree, begin), np.minimum.reduceat(name, begin))], names=["node", "pairs", "agree", "least"])


def compare_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates inside small nodes, from (node, a, tokens) sorted by node: links to the smallest that is reached."""
    for table, cut in groups(batches):
        name = table.column(1).to_numpy()
        tokens = unpacked(table.column(2)).astype(np.uint8)
        sizes = np.diff(cut)
        out_u, out_v = [], []
        for m in np.unique(sizes[sizes > 1]).tolist():
            begin = cut[:-1][sizes == m]
            step = max(1, 400_000 // (m * m))
            for k in range(0, len(begin), step):
                index = begin[k : k + step][:, None] + np.arange(m)
                own = tokens[index]
                same = np.zeros((len(index), m, m), np.uint8)
                for t in range(TOKENS):
                    same += own[:, :, None, t] == own[:, None, :, t]
                label = smallest_reached(same >= AGREE, name[index])
                far = label != name[index]
                out_u.append(name[index][far])
                out_v.append(label[far])
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (u, v) that join all classes which may be similar; ``classes`` has a and tokens."""
    known = classes.select(F.col("a").alias("_a"), "tokens")
    rows = classes.select(F.lit(0).cast("long").alias("node"), "a", "tokens")
    found = links = None
    for level in range(MAX_LEVELS):
        # Deeper levels have few rows: they carry their tokens, and draw two at once to fall apart in fewer rounds.
        dealt = pin(deal(rows, level, 1, 2, True)) if level else deal(rows, 0, run_count(), 1, False)
        counts = pin(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        kept = pin(dealt.join(counts, "node"))
        few = kept.filter(F.col("n") <= LIMIT).select("node", "a")
        found = few if found is None else found.union(few)
        hot = kept.filter(F.col("n") > LIMIT)
        hot = hot.select("node", "a", "tokens") if level else pin(hot.join(known, F.col("a") == F.col("_a")).select("node", "a", "tokens"))
        # How alike a node's classes are: the share of tokens in which two of them agree, over neighbouring rows.
        seen = hot.mapInArrow(likeness, "node long, pairs long, agree long, least long").groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum("agree").alias("agree"), F.min("least").alias("v"))
        last = F.lit(level == MAX_LEVELS - 1)
        judged = pin(seen.select(F.col("node").alias("_node"), "v", (last | (F.col("agree") >= ALIKE * TOKENS * F.col("pairs"))).alias("whole")))
        some_whole, all_whole = judged.agg(F.max("whole"), F.min("whole")).first()
        if all_whole is None:
            break
        met = hot.join(judged, F.col("node") == F.col("_node"))
        if some_whole:
            more = met.filter("whole").select(F.col("a").alias("u"), "v")
            links = more if links is None else links.union(more)
        if all_whole:
            break
        rows = met.filter("NOT whole").select("node", "a", "tokens")
    met = found.join(known, F.col("a") == F.col("_a")).select("node", "a", "tokens")
    small_nodes = met.repartition("node").sortWithinPartitions("node").mapInArrow(compare_nodes, "u long, v long")
    return small_nodes if links is None else small_nodes.union(links)


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of 0.8 or more, exactly."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # values of one set only add nothing
    kept = often[column]
    column, owner = (np.cumsum(often) - 1)[column[kept]], owner[kept]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    common[np.diag_indices(len(sets))] = size
    return 9 * common.astype(np.int64) >= 4 * (size[:, None] + size[None, :])


def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links counted in each task group, from (task, side, a, copies, shingles) sorted by task.

    Side 0 rows are compared with each other (a block with itself) if there is no side 1, else with those of side 1.
    """
    for table, cut in groups(batches, 4_000):
        side, name, copies = (table.column(k).to_numpy() for k in (1, 2, 3))
        lists = table.column(4).combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            near = similar([flat[at[k] : at[k + 1]] for k in range(lo, hi)])
            np.fill_diagonal(near, False)
            if side[lo:hi].any():
                near &= side[lo:hi][:, None] != side[lo:hi][None, :]
            linked = near @ copies[lo:hi]
            label = smallest_reached(near[None], name[None, lo:hi])[0]
            out.append((name[lo:hi], linked, label))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "linked", "label"])


def join(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class_id, n_links)`` for each row of ``documents``."""
    kind = documents.schema[key].dataType.simpleString()
    drawn = pin(sketches(documents, key, text))
    classes = pin(drawn.filter("size > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")))
    labels = components(candidate_links(classes)).withColumnRenamed("node", "_a")
    sizes = pin(labels.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("m")))
    members = labels.join(sizes, F.col("label") == F.col("_label")).select("_a", "label", "m")
    members = pin(classes.select("a", "b", "rep", "copies").join(members, F.col("a") == F.col("_a")).drop("_a"))

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in pieces(batch.column(0)):
                value, cut = shingles(data, at)
                a, b, _ = names(value, cut)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["_a", "_b", "shingles"])

    reps = small(members.select(F.col("rep").alias("_rep")).distinct(), members.count(), BROADCAST_MEMBERS)
    texts = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(reps, F.col("_key").eqNullSafe(F.col("_rep")), "left_semi")
    sets = texts.select("_text").mapInArrow(shingled, "_a long, _b long, shingles array<long>").dropDuplicates(["_a", "_b"])
    whole = members.join(sets, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("a"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).cast("int").alias("side")))
    tasks = whole.select("label", "a", "copies", "shingles", F.explode(pairs).alias("t"))
    tasks = tasks.select(F.xxhash64("label", "t.i", "t.j").alias("task"), F.col("t.side").alias("side"), "a", "copies", "shingles")
    checked = pin(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(verify, "a long, linked long, label long"))
    linked = checked.groupBy(F.col("a").alias("_a")).agg(F.sum("linked").alias("linked"))
    final = components(checked.filter("a <> label").select(F.col("a").alias("u"), F.col("label").alias("v")))
    named = members.join(final, F.col("a") == F.col("node"), "left").select("a", "b", "rep", F.coalesce(final["label"], "a").alias("group"))
    first = pin(named.groupBy(F.col("group").alias("_group")).agg(F.min("rep").alias("class_id")))
    found = pin(named.join(first, F.col("group") == F.col("_group")).join(linked, F.col("a") == F.col("_a")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "class_id", "linked"))
    own_class = pin(classes.select("a", "b", "rep", "copies").join(found, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select(
        F.col("a").alias("_a"), F.col("b").alias("_b"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    ))
    out = drawn.select("id", "a", "b", "size").join(own_class, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").cast(kind).alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
