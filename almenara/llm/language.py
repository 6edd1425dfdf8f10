"""Language ID by prediction by partial matching: the language whose byte statistics give the shortest code.

For every language Spark counts which byte follows which context of up to ``ORDER`` bytes, over lower-cased text.
A byte seen after its longest context costs -log2(count / (total + kinds)); otherwise it costs an escape,
log2((total + kinds) / kinds), and is coded after the context without its first byte, down to eight bits flat. The
statistics are frozen before scoring, so the length of a text's code is exact and depends on the text alone.

Equal contexts of all languages lie in one table per order, so one lookup serves all languages; whole texts are
scored where they lie. Learning takes about ``sample_rows`` texts of each language at most, chosen by a hash of
the id, equal texts once; counts are summed by Spark, and the model grows with that sample, not with the corpus.

A null language is not learned from. A text that is null or has no letter is ``und`` with score 0; so is every text
when nothing was learned. Ties go to the smaller name. Repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.llm.arrays import pieces

ORDER = 4
SAMPLE_ROWS = 1_500
UNKNOWN = "und"
PAD = 10
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Row numbers of sorted distinct keys by open addressing; ``find`` gives -1 for other keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(len(keys) * 2.2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        home, left, step = self.home(keys), np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            place = (home[left] + step) & ((1 << self.bits) - 1)
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            left, step = left[self.slots[place] != left], step + 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self.home(keys)
        out = self.slots[place]
        if not len(self.keys):
            return out
        wrong = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slots[place[wrong]]
            wrong = wrong[(self.keys[out[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


@dataclass
class Model:
    """For each order: the table of contexts with a next byte and its code lengths; contexts and their escapes."""

    languages: list[str]
    grams: list[Table]
    bits: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]


def windows(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, the newest lowest; texts begin after pad bytes."""
    key = np.zeros(len(data), np.uint64)
    begin = at[:-1][np.diff(at) > 0]
    stop = at[1:][np.diff(at) > 0]
    for back in range(order, -1, -1):
        old = np.empty(len(data), np.uint64)
        old[back:] = data[: len(data) - back] if back else data
        old[: min(back, len(data))] = PAD
        for k in range(back):
            inside = begin + k < stop
            old[(begin + k)[inside]] = PAD
        key = key << np.uint64(8) | old
    return key


def count_grams(texts: pa.Array, language: np.ndarray) -> pd.DataFrame:
    """Counts of (language number, order, context with next byte)."""
    out = []
    for lo, hi, data, at in pieces(texts, 4 << 20):
        key = windows(data, at)
        lang = np.repeat(language[lo:hi].astype(np.uint64), np.diff(at))
        for k in range(ORDER + 1):
            part = key & np.uint64((1 << 8 * (k + 1)) - 1)
            own, n = np.unique(part | lang << np.uint64(48), return_counts=True)
            out.append(pd.DataFrame({"lang": (own >> np.uint64(48)).astype(np.int64), "ord": k, "gram": (own & np.uint64((1 << 48) - 1)).astype(np.int64), "n": n}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "ord": [], "gram": [], "n": []}).astype("int64")


def build(counts: pd.DataFrame, languages: list[str]) -> Model:
    """Code lengths and escapes of every context; a language that lacks a row falls back within itself."""
    model = Model(languages, [], [], [], [])
    width = len(languages)
    for k in range(ORDER + 1):
        own = counts[counts["ord"] == k]
        gram, lang, n = own["gram"].to_numpy(np.uint64), own["lang"].to_numpy(np.int64), own["n"].to_numpy(float)
        keys = np.unique(gram)
        times = np.zeros((len(keys), width))
        times[np.searchsorted(keys, gram), lang] = n
        roots = np.unique(keys >> np.uint64(8))
        at = np.searchsorted(roots, keys >> np.uint64(8))
        total, kinds = np.zeros((len(roots), width)), np.zeros((len(roots), width))
        np.add.at(total, at, times)
        np.add.at(kinds, at, times > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
            length = -np.log2(times / (total + kinds)[at])
        below = np.full((len(keys), width), 8.0) if k == 0 else model.bits[k - 1][model.grams[k - 1].find(keys & np.uint64((1 << 8 * k) - 1))]
        length = np.where(times > 0, length, escape[at] + below)
        model.grams.append(Table(keys))
        model.bits.append(length.astype(np.float32))
        model.contexts.append(Table(roots))
        model.escapes.append(escape.astype(np.float32))
    return model


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Bits that each text takes under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    for lo, hi, data, at in pieces(texts):
        if not len(data):
            continue
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        key = windows(data, at)

        def add(rows: np.ndarray, who: np.ndarray) -> None:
            for j in range(rows.shape[1]):
                out[lo:hi, j] += np.bincount(who, weights=rows[:, j], minlength=hi - lo)

        for k in range(ORDER, -1, -1):
            row = model.grams[k].find(key & np.uint64((1 << 8 * (k + 1)) - 1))
            hit = row >= 0
            add(model.bits[k][row[hit]], doc[hit])
            if hit.all():
                break
            key, doc = key[~hit], doc[~hit]
            row = model.contexts[k].find((key & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))
            add(model.escapes[k][row[row >= 0]], doc[row >= 0])
            if k == 0:
                out[lo:hi] += 8.0 * np.bincount(doc, minlength=hi - lo)[:, None]
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Frozen statistics of every language in ``lang``."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return build(pd.DataFrame({"lang": [], "ord": [], "gram": [], "n": []}), [])
    shares = [(name, k, int((share := min(1.0, sample_rows / sizes[name])) * (1 << 20)) + int(share >= 1.0)) for k, name in enumerate(languages)]
    # The same list of languages as in the model.
    chosen = F.broadcast(labelled.sparkSession.createDataFrame(shares, "_lang string, k int, _part int"))
    rows = rows.join(chosen, F.col("lang") == F.col("_lang")).filter(F.pmod("h", F.lit(1 << 20)) < F.col("_part"))
    rows = rows.select("text", "k").withColumn("t", F.xxhash64("text")).dropDuplicates(["t", "k"])

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield count_grams(pa.array(b["text"], pa.large_string()), b["k"].to_numpy())

    counts = rows.select("text", "k").mapInPandas(count, "lang long, ord long, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    return build(counts.toPandas(), languages)


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language and its share of the evidence (0 to 1)."""
    docs = docs.drop(name, score)
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The lower-cased text travels beside the row only as long as the task needs it.
    clean = F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text)))
    ready = docs.withColumn("_clean", clean)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(len(kept))
            names, scores = pa.array([UNKNOWN] * len(batch), pa.string()), np.zeros(len(batch))
            if m.languages:
                bits = code_lengths(m, column)
                best = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                sure = np.asarray(column.is_valid())
                scores = np.where(sure, 1.0 / np.exp2(-gap).sum(axis=1), 0.0)
                pick = pa.array(np.where(sure, best, len(m.languages)))
                names = pa.array([*m.languages, UNKNOWN], pa.string()).take(pick)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], names, pa.array(scores)], names=[*kept, name, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return ready.mapInArrow(run, f"{fields}, `{name}` string, `{score}` double")
