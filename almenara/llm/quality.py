"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A text is cut at white space. Every token gives two words: its letters and digits (lower case, digits alike) and
its form (case, kind of characters, punctuation, whether it repeats the token before). Features are the uni- and
bigrams of the first and the uni- to trigrams of the second, hashed to ``BITS`` bits; a feature is present or not.

Training follows FTRL-Proximal. The labelled rows, at most about ``sample_rows`` chosen by a hash of the id, are
dealt by that hash to groups of about ``SHARD_ROWS``; each group is one task with its own learner, and the
weights are averaged by Spark. Small groups are passed over more often. The L1 term leaves few weights, so scoring looks up each feature once and sums the
hits: texts are read where they lie and nothing is shuffled.

Null or empty text has no feature: its score is that of the bias. Rows without a label, or with a label other than
0 and 1, are not learned from. Without any labelled row every score is 0.5. Repeated rows are scored alike; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.llm.arrays import DIGIT, LETTER, WHITE, WORD, Hasher, combined, lowered, mix, pieces, runs, summed
from almenara.llm.sampling import labelled_sample

BITS = 20
SAMPLE_ROWS = 24_000
SHARD_ROWS = 4_000
UPDATES = 12_000


@dataclass(frozen=True)
class Rates:
    """Settings of FTRL-Proximal; at least ``epochs`` passes over each group, and ``UPDATES`` updates."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text of a piece with repeats: (text number, feature)."""
    starts, ends, doc = runs(~WHITE[data], at)
    if not len(starts):
        return doc, np.zeros(0, np.int64)
    low, upper = lowered(data)
    plain = low.copy()
    plain[DIGIT[data]] = ord("0")
    plain[~WORD[data]] = 0
    word = Hasher(plain)(starts, ends)
    marks = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    marks = mix(marks + np.uint64(7))
    marks[WORD] = 0
    punctuation = summed(marks[data])
    punctuation = punctuation[ends] - punctuation[starts]
    large, digits = summed(upper), summed(DIGIT[data])
    letters = summed(LETTER[data] & (data < 0xC0))  # one per letter of one or two bytes
    n_large, n_digit, n_letter = (x[ends] - x[starts] for x in (large, digits, letters))
    head = upper[starts] | (upper[np.minimum(starts + 1, len(data) - 1)] & (data[starts] == 0xC3))
    case = np.where(n_letter == 0, 0, np.where(n_large == 0, 1, np.where((n_large == n_letter) & (n_letter > 1), 2, np.where(head & (n_large == 1), 3, 4))))
    same_doc = np.zeros(len(doc), bool)
    same_doc[1:] = doc[1:] == doc[:-1]
    again = same_doc.copy()
    again[1:] &= word[1:] == word[:-1]
    form = mix(punctuation + (case + 8 * (n_digit > 0) + 16 * again + 32 * (n_letter > 0)).astype(np.uint64))
    out_doc, out = [doc, doc], [word, form ^ np.uint64(0x5A5A)]
    two = np.flatnonzero(same_doc)
    pair = combined(form[two - 1], form[two])
    out += [combined(word[two - 1], word[two]), pair ^ np.uint64(0x3C3C)]
    out_doc += [doc[two]] * 2
    follows = np.flatnonzero(same_doc[two - 1]) if len(two) else two
    three = two[follows]
    out.append(combined(pair[follows], form[three - 2]) ^ np.uint64(0x77))
    out_doc.append(doc[three])
    return np.concatenate(out_doc), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def train(texts: pa.Array, labels: np.ndarray, rates: Rates, order: np.ndarray | None = None) -> np.ndarray:
    """Weights of one learner over its rows; the last weight is the bias."""
    sets: list[np.ndarray] = []
    for lo, hi, data, at in pieces(texts):
        doc, feature = features(data, at)
        own = np.unique(doc << BITS | feature)
        cut = np.searchsorted(own, np.arange(hi - lo + 1) << BITS)
        sets += [np.append(own[a:b] & ((1 << BITS) - 1), 1 << BITS) for a, b in zip(cut[:-1], cut[1:])]
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros_like(z)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        l1 = np.full(len(z[i]), rates.l1)
        l1[-1] = 0.0  # the bias stands last and is not held down
        over = np.abs(z[i]) - l1
        return np.where(over <= 0, 0.0, -np.sign(z[i]) * over / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2))

    for _ in range(max(rates.epochs, min(30, UPDATES // max(1, len(sets))))):
        for k in order if order is not None else range(len(sets)):
            i = sets[k]
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rates.alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(slice(None))


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, rates: Rates = Rates()) -> np.ndarray:
    """Weights learned from the texts that ``labels`` marks; about ``sample_rows`` of them at most."""
    rows, drawn = labelled_sample(documents, labels, sample_rows, key, text, label)
    shards = max(1, round(drawn / SHARD_ROWS))
    # One row may repeat without end: equal rows count once, so that no group outgrows its bound.
    rows = rows.dropDuplicates(["h", "label"]).withColumn("shard", F.pmod(F.shiftright("h", 24), F.lit(shards)))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "label"])
        w = train(pa.array(frame["text"], pa.large_string()), frame["label"].to_numpy(float), rates)
        kept = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(kept, -1), "weight": np.append(w[kept], 1.0)})  # -1 counts the learners

    learned = rows.groupBy("shard").applyInPandas(learn, "feature long, weight double")
    # At most 2**BITS + 1 averaged weights come back: the bound of the model, whatever the size of the table.
    found = learned.groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()
    w = np.zeros((1 << BITS) + 2, np.float32)
    w[found["feature"].to_numpy(np.int64)] = found["weight"].to_numpy()
    return w[:-1] / max(w[-1], 1)


def margins(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The dot product of each text's features with the weights."""
    out = np.full(len(texts), float(weights[-1]))
    for lo, hi, data, at in pieces(texts):
        doc, feature = features(data, at)
        w = weights[feature]
        hit = np.flatnonzero(w)
        own, first = np.unique(doc[hit] << BITS | feature[hit], return_index=True)
        out[lo:hi] += np.bincount(own >> BITS, weights=w[hit][first], minlength=hi - lo)
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the chance, 0 to 1, that a text is of label 1, appended as ``name`` (replacing a column so named)."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = margins(shared.value, batch.column(kept.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(m, -35, 35))))], names=[*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")
